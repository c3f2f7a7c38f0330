"""Ballistic arcs of shots: fits to calibrated sightings, and what follows from their parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.shared import spread

# Gravity in feet a second squared, the rim's height in feet.
GRAVITY, RIM_FT = 32.174, 10.0
# A plausible shot's reprojection error (pixels), apex (feet) and launch angle (degrees); a
# physical window's least samples, release height and lowest point.
MOST_RMSE, APEX, ANGLE = 25.0, (10.0, 30.0), (20.0, 75.0)
LEAST_SAMPLES, LEAST_RELEASE, LEAST_HEIGHT = 4, 4.0, -1.0

FITS = "x0 double, vx double, y0 double, vy double, z0 double, vz double, n int, rmse double, flipped boolean, min_z double"


def fit_many(cameras: np.ndarray, uv: np.ndarray, t: np.ndarray, gravity: float = GRAVITY) -> list[np.ndarray]:
    """FITS of falling bodies seen equally often: 3x4 ``cameras`` (m, n, 3, 4), places ``uv`` (m, n, 2), times (m, n).

    Position and speed at time 0 by linear least squares; the root mean square of the reprojection errors, whether
    the cameras' height axis had to be turned up, and the lowest point at a sighting.
    """
    m, n = t.shape
    # Height of each camera's eye, by Cramer's rule; 0 where the camera is degenerate.
    det, third = np.linalg.det(cameras[..., :3]), np.linalg.det(cameras[..., [0, 1, 3]])
    eyes = np.divide(-third, det, out=np.zeros_like(det), where=det != 0)
    flipped = np.median(eyes, axis=1) < 0
    cameras = np.where(flipped[:, None, None, None], cameras * np.array([1.0, 1.0, -1.0, 1.0]), cameras)
    # Each sighting says twice that a row of its camera, less u or v times the third, is orthogonal to the place.
    rows = (cameras[:, :, :2] - uv[..., None] * cameras[:, :, 2:]).reshape(m, 2 * n, 4)
    when = np.repeat(t, 2, axis=1)
    design = np.stack([rows[..., 0], rows[..., 0] * when, rows[..., 1], rows[..., 1] * when, rows[..., 2], rows[..., 2] * when], -1)
    known = rows[..., 3] - 0.5 * gravity * when**2 * rows[..., 2]
    p = -(np.linalg.pinv(design, rcond=2 * n * np.finfo(float).eps) @ known[..., None])[..., 0]
    at = np.stack([p[:, :1] + p[:, 1:2] * t, p[:, 2:3] + p[:, 3:4] * t, p[:, 4:5] + p[:, 5:6] * t - 0.5 * gravity * t**2, np.ones_like(t)], -1)
    seen = np.einsum("mnij,mnj->mni", cameras, at)
    ok = np.abs(seen[..., 2]) >= 1e-9
    off = seen[..., :2] / np.where(ok, seen[..., 2], 1.0)[..., None] - uv
    error = ((off**2).sum(-1) * ok).sum(1)
    return [*p.T, np.full(m, n), np.sqrt(error / n), flipped, at[..., 2].min(1)]


def fit_arc(cameras: np.ndarray, uv: np.ndarray, t: np.ndarray, gravity: float = GRAVITY) -> tuple | None:
    """``fit_many`` of one body; None from fewer than three sightings."""
    if len(t) < 3:
        return None
    return tuple(c[0].item() for c in fit_many(cameras[None], uv[None], t[None], gravity))


def fit_arcs(samples: DataFrame, keys: list[str], gravity: float = GRAVITY) -> DataFrame:
    """``fit_many`` of each arc of ``samples`` (keys, t, u, v, camera: 12 numbers, row by row); arcs of fewer than three
    sightings are left out, and sightings that lack a number.

    An arc lasts about a second, so it is gathered as a list of some dozens of sightings; lists stream through
    tasks, and those of one length are solved together.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    seen = samples.where(finite(F.col("t")) & finite(F.col("u")) & finite(F.col("v")) & (F.size("camera") == 12) & F.forall("camera", finite))
    number = lambda c: F.col(c).cast("double").alias(c)
    lists = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(number("t"), number("u"), number("v"), F.col("camera").cast("array<double>").alias("camera")))).alias("__seen")).where(F.size("__seen") >= 3)
    names, kinds = zip(*(c.split() for c in FITS.split(", ")), strict=True)
    types = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = b.column("__seen")
            starts, ends = seen.offsets.to_numpy()[:-1], seen.offsets.to_numpy()[1:]
            t, u, v = (seen.values.field(c).to_numpy() for c in ("t", "u", "v"))
            cameras = seen.values.field("camera").flatten().to_numpy().reshape(-1, 3, 4)
            out: list = [np.zeros(b.num_rows, bool if k == "boolean" else float) for k in kinds]
            for n in np.unique(ends - starts):
                arcs = np.flatnonzero(ends - starts == n)
                at = starts[arcs][:, None] + np.arange(n)
                for place, c in enumerate(fit_many(cameras[at], np.stack([u[at], v[at]], -1), t[at], gravity)):
                    out[place][arcs] = c
            cells = [pa.array(c.astype(np.int32) if k == "int" else c, types[k]) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *cells], [*keys, *names])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*keys).schema), FITS])
    return spread(lists, *keys).mapInArrow(run, ddl)


def launch_speed(vx: Column, vy: Column, vz: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy + vz * vz)


def launch_angle(vx: Column, vy: Column, vz: Column) -> Column:
    """Degrees above the horizontal."""
    return F.degrees(F.atan2(vz, F.sqrt(vx * vx + vy * vy)))


def apex_height(z0: Column, vz: Column, highest_seen: Column, gravity: float = GRAVITY) -> Column:
    return F.when(vz > 0, z0 + vz * vz / (2 * gravity)).otherwise(highest_seen)


def times_at(z0: Column, vz: Column, z: float, gravity: float = GRAVITY) -> tuple[Column, Column]:
    """The two times at which an arc is ``z`` feet high, null if it never is."""
    d = vz * vz + 2 * gravity * (z0 - z)
    root = F.when(d >= -1e-9, F.sqrt(F.greatest(d, F.lit(0.0))))
    return (vz - root) / gravity, (vz + root) / gravity


def arc_end(z0: Column, vz: Column, after: Column, gravity: float = GRAVITY) -> Column:
    """struct(t, how): the arc's end past its last sighting: falling through the rim's height or to the
    floor, whichever is first, else the last sighting."""
    rim, floor = times_at(z0, vz, RIM_FT, gravity)[1], times_at(z0, vz, 0.0, gravity)[1]
    late = F.greatest(after, vz / gravity) + 1e-9
    end = lambda t, how: F.struct(t.alias("t"), F.lit(how).alias("how"))
    return F.when((rim > late) & (~(floor > late) | (rim <= floor)), end(rim, "rim")).when(floor > late, end(floor, "floor")).when(floor > after + 1e-9, end(floor, "floor")).otherwise(end(after, "observed"))


def is_plausible(rmse: Column, apex: Column, angle: Column) -> Column:
    return (rmse < MOST_RMSE) & (apex > APEX[0]) & (apex < APEX[1]) & (angle > ANGLE[0]) & (angle < ANGLE[1])


def is_physical(n: Column, z0: Column, min_z: Column) -> Column:
    return (n >= LEAST_SAMPLES) & (z0 >= LEAST_RELEASE) & (min_z >= LEAST_HEIGHT)


def match_greedy(said: list[tuple], truths: list[tuple], least: list[float]) -> list[list[bool]]:
    """For each threshold, whether each of ``said`` (boxes, surest first) meets a truth of its own."""
    # Of each box the truths that overlap it, the most first and of equal ones the first: the same for all thresholds.
    ranked = []
    for b in said:
        over = [(_iou(b, g), -i) for i, g in enumerate(truths) if b[0] < g[2] and g[0] < b[2] and b[1] < g[3] and g[1] < b[3]]
        ranked.append(sorted((o for o in over if o[0] > 0), reverse=True))
    out = []
    for bound in least:
        taken, hits = set(), []
        for over in ranked:
            best, at = next((o for o in over if o[1] not in taken), (0.0, None))
            hits.append(at is not None and best >= bound)
            if hits[-1]:
                taken.add(at)
        out.append(hits)
    return out


def _iou(a: tuple, b: tuple) -> float:
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def _boxes_by_row(lists: pa.Array, corners: tuple[str, ...]) -> list[list[tuple]]:
    """The boxes of each row's list of structs; none of a null list."""
    each = lists.flatten()
    boxes = list(zip(*(each.field(c).to_pylist() for c in corners), strict=True))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
    return [boxes[a:b] for a, b in zip([0, *ends], ends)]


def matched_lists(said: DataFrame, truths: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """keys, det_idx, confidence and hits, one a threshold, of each box of ``said`` (det_idx, confidence, x1 to y2), by
    greedy matching within an image and class with ``truths`` (x1 to y2 and gt_idx).

    The boxes of one image and class are gathered as two short lists; so images stream through tasks.
    """
    corners = ("x1", "y1", "x2", "y2")
    order = F.struct((-F.col("confidence")).alias("o"), "det_idx", "confidence", *corners)
    a = said.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("said"))
    b = truths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gt_idx", *corners))).alias("truths"))
    rows = spread(a.join(b, keys, "left"), *keys)
    fields = [*rows.select(*keys).schema]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "hits array<array<boolean>>", "said array<struct<det_idx:bigint,confidence:double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, truths = (_boxes_by_row(batch.column(c), corners) for c in ("said", "truths"))
            hits = pa.array([list(map(list, zip(*match_greedy(s, t, thresholds)))) for s, t in zip(said, truths, strict=True)], pa.list_(pa.list_(pa.bool_())))
            each, ends = batch.column("said").flatten(), np.cumsum([0, *map(len, said)])
            answers = pa.StructArray.from_arrays([each.field("det_idx").cast(pa.int64()), each.field("confidence").cast(pa.float64())], ["det_idx", "confidence"])
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), answers)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), hits, kept], [*keys, "hits", "said"])

    each = rows.mapInArrow(run, ddl).select(*keys, F.explode(F.arrays_zip("said", "hits")).alias("x"))
    return each.select(*keys, "x.said.det_idx", "x.said.confidence", "x.hits")


def matched(said: DataFrame, truths: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """``matched_lists`` with a row a threshold: keys, det_idx, confidence, threshold and hit."""
    each = matched_lists(said, truths, keys, thresholds).select(*keys, "det_idx", "confidence", F.posexplode("hits").alias("i", "hit"))
    return each.select(*keys, "det_idx", "confidence", F.element_at(F.array(*map(F.lit, thresholds)), F.col("i") + 1).alias("threshold"), "hit")
