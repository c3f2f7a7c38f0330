"""Windows of a ball's sightings that hold a shot's arc, and where the arc meets the rim."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import distance
from hardwood.operators.arcs import GRAVITY, LEAST_HEIGHT, LEAST_RELEASE, fit_arc
from hardwood.operators.joins import first_by, nearest_in_time
from hardwood.operators.sequences import quadratic_fit, with_runs
from hardwood.shared import spread

# Seconds on either side of the highest point, greatest error and least height of an arc in pixels.
HALF_S, MOST_ERROR, LEAST_AMPLITUDE = 0.5, 22.0, 60.0
# Seconds that a window may reach back, error it may then have (pixels), frames it may skip at once.
BACK_S, BACK_ERROR, BACK_GAP = 1.2, 20.0, 4
# Steps along an arc's end, and the distances that count as a hit and as near, in rim radii.
STEPS, HIT, NEAR = 400, 1.25, 3.0


def arc_windows(sightings: DataFrame, keys: list[str], fps: float, min_len: int, amplitude: float = LEAST_AMPLITUDE) -> DataFrame:
    """keys, lo, hi, amplitude: of each key's runs of frames, cut to HALF_S around the highest sighting (``v``, down the
    image), the one with the greatest amplitude whose parabola opens toward the bottom of the image, fits and has its vertex inside.

    Keys, runs and sums are grouped by Spark; of a run only its window's rows are fitted.
    """
    half = max(min_len // 2, round(HALF_S * fps))
    run = [*keys, "run_id"]
    whole = Window.partitionBy(*run)
    rows = with_runs(sightings.select(*keys, "frame_index", F.col("v").cast("double").alias("v")), keys, "frame_index", 1)
    top = F.min(F.struct("v", "frame_index")).over(whole)["frame_index"]
    rows = rows.withColumns({"n": F.count("*").over(whole), "top": top}).where((F.col("n") >= min_len) & (F.abs(F.col("frame_index") - F.col("top")) <= half))
    rows = rows.withColumn("lo", F.min("frame_index").over(whole)).withColumn("t", F.col("frame_index") - F.col("lo"))
    fit = rows.join(quadratic_fit(rows, run, "t", "v"), run)
    off = F.col("v") - (F.col("a") * F.col("t") * F.col("t") + F.col("b") * F.col("t") + F.col("c"))
    arcs = fit.groupBy(*run, "lo", "a", "b").agg(F.max("frame_index").alias("hi"), F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("amplitude"), F.sqrt(F.avg(off * off)).alias("rms"))
    good = (F.col("n") >= min_len) & (F.col("a") > 0) & (-F.col("b") / (2 * F.col("a"))).between(0, F.col("n") - 1) & (F.col("rms") <= MOST_ERROR) & (F.col("amplitude") >= amplitude)
    return first_by(arcs.where(good), keys, F.desc("amplitude"), "lo").select(*keys, "lo", "hi", "amplitude")


def reach_back(frames: np.ndarray, uv: np.ndarray, cameras: np.ndarray, lo: int, hi: int, fps: float) -> int:
    """First frame of the window once earlier sightings joined it one by one, as long as the whole is one free flight."""
    order = np.argsort(frames)
    frames, uv, cameras = frames[order], uv[order], cameras[order]
    first, last = int(np.searchsorted(frames, lo)), int(np.searchsorted(frames, hi, "right"))
    for _ in range(round(BACK_S * fps)):
        if first == 0 or frames[first] - frames[first - 1] > BACK_GAP:
            break
        part = slice(first - 1, last)
        got = fit_arc(cameras[part], uv[part], (frames[part] - frames[first - 1]) / fps)
        if got is None or got[7] > BACK_ERROR or got[4] < LEAST_RELEASE or got[9] < LEAST_HEIGHT:
            break
        first -= 1
    return int(frames[first])


def extended_windows(samples: DataFrame, windows: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """``windows`` (keys, lo, hi) with ``lo`` moved back to the release, from ``samples`` (keys, frame_index, u, v, camera).

    A group holds what can join one window: its own second and BACK_S before, with the gaps allowed.
    """
    far = round(BACK_S * fps) * BACK_GAP
    rows = samples.join(windows.select(*keys, "lo", "hi"), keys).where(F.col("frame_index").between(F.col("lo") - far, F.col("hi")))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        frames, u, v = (table.column(c).to_numpy() for c in ("frame_index", "u", "v"))
        cameras = np.array(table.column("camera").to_pylist(), float).reshape(-1, 3, 4)
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        back = reach_back(frames, np.stack([u, v], 1), cameras, lo, hi, fps)
        return table.select([*keys]).slice(0, 1).append_column("lo", pa.array([back], pa.int64())).append_column("hi", pa.array([hi], pa.int64()))

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "lo long, hi long"])
    return spread(rows.withColumns({"lo": F.col("lo").cast("long"), "hi": F.col("hi").cast("long")}), *keys).groupBy(*keys).applyInArrow(run, ddl)


def earliest_release(windows: DataFrame, releases: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """``windows`` with ``release``: the first frame of ``releases`` from 1.5 seconds before ``hi`` to ``hi``, else null."""
    w = windows.select(*keys, F.col("hi").alias("__hi"))
    inside = releases.join(w, keys).where(F.col("frame_index").between(F.col("__hi") - int(1.5 * fps), F.col("__hi")))
    return windows.join(inside.groupBy(*keys, F.col("__hi").alias("hi")).agg(F.min("frame_index").alias("release")), [*keys, "hi"], "left")


def rim_targets(windows: DataFrame, rims: DataFrame, keys: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Median rim (rim_x, rim_y, rim_r) of each window's frames, of all frames of its key where those have fewer than two.

    With ``frames`` (keys, frame_index) only these count as a window's.
    """
    if frames is None:
        rims = rims.withColumn("__in", F.lit(True))
    else:
        rims = rims.join(frames.select(*keys, "frame_index", F.lit(True).alias("__in")), [*keys, "frame_index"], "left")
    seen = windows.select(*keys, "lo", "hi").join(rims, keys).withColumn("inside", F.col("frame_index").between(F.col("lo"), F.col("hi")) & F.col("__in").isNotNull())
    names = ("rim_x", "rim_y", "rim_r")
    median = lambda c, only: F.median(F.when(F.col("inside") | F.lit(not only), F.col(c)))
    out = seen.groupBy(*keys, "lo", "hi").agg(F.count_if("inside").alias("n"), *(median(c, o).alias(f"{c}_{o}") for c in names for o in (True, False)))
    return out.select(*keys, "lo", "hi", *(F.when(F.col("n") >= 2, F.col(f"{c}_True")).otherwise(F.col(f"{c}_False")).alias(c) for c in names))


def camera_projection(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Place in the image by a 3x4 camera (12 numbers, row by row); null where the scale is all but 0."""
    row = lambda i: m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3]
    w = F.when(F.abs(row(2)) >= 1e-9, row(2))
    return row(0) / w, row(1) / w


def ends_at_rim(arcs: DataFrame, cameras: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """keys and t_rim: when an arc, on its way down, first comes within HIT radii of the rim as seen by the camera
    nearest in time, else when it is closest, if within NEAR radii; arcs that come no nearer are left out.

    ``arcs``: keys, lo, x0 to vz, after, t_end, rim_x, rim_y, rim_r. Each is laid out in STEPS times.
    """
    early = F.greatest("after", F.col("vz") / GRAVITY) + 1e-6
    laid = arcs.withColumn("__lo", early).where("t_end > __lo").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    laid = laid.withColumn("t", F.col("__lo") + F.col("k") * (F.col("t_end") - F.col("__lo")) / (STEPS - 1))
    laid = laid.withColumn("frame_index", (F.col("lo") + F.rint(F.col("t") * fps)).cast("long"))
    seen = nearest_in_time(laid, cameras, keys, "frame_index", "camera")
    t = F.col("t")
    at = (F.col("x0") + F.col("vx") * t, F.col("y0") + F.col("vy") * t, F.col("z0") + F.col("vz") * t - 0.5 * GRAVITY * t * t)
    u, v = camera_projection(F.col("camera"), *at)
    seen = seen.withColumn("d", distance(F.rint(u), F.rint(v), F.col("rim_x"), F.col("rim_y"))).where("d is not null")
    hit, near = F.min(F.when(F.col("d") <= HIT * F.col("rim_r"), t)), F.min(F.when(F.col("d") <= NEAR * F.col("rim_r"), F.struct("d", "t")))["t"]
    return seen.groupBy(*keys).agg(F.coalesce(hit, near).alias("t_rim")).where("t_rim is not null")
