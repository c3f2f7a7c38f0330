"""Shots in space: from a ball's sightings and the cameras of its frames to arcs, their metrics and what a viewer draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hardwood.functions.geometry import M_PER_FT, distance
from hardwood.operators import arcs as A
from hardwood.operators import windows as W
from hardwood.shared import spread, written

# Places along a drawn arc at least, and a frame's share of them; seconds drawn past the last sighting at
# least; pixels from the rim beyond which the drawn arc is led to it.
LEAST_PLACES, PLACES_A_FRAME, PAST_S, AT_RIM_PX = 90, 2, 0.4, 4.0

METRICS = ("lo", "hi", "x0", "vx", "y0", "vy", "z0", "vz", "n", "rmse", "flipped", "frames", "points", "t_seen", "apex", "speed", "angle", "plausible", "t_end", "how", "rim_x", "rim_y", "rim_r")


def shot_samples(balls: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Sightings (keys, frame_index, u, v) of frames that have a camera, with it; written, as windows and fits read them again."""
    return written(balls.select(*keys, "frame_index", "u", "v").join(cameras.select(*keys, "frame_index", "camera"), [*keys, "frame_index"]), "shot-samples")


def _times(samples: DataFrame, windows: DataFrame, keys: list[str], fps: float, first: str = "lo") -> DataFrame:
    """``samples`` inside their key's window, with ``t``, seconds from its first frame."""
    inside = samples.join(windows.select(*keys, F.col(first).alias("__lo"), F.col("hi").alias("__hi")), keys)
    inside = inside.where(F.col("frame_index").between(F.col("__lo"), F.col("__hi")))
    return inside.withColumn("t", (F.col("frame_index") - F.col("__lo")) / F.lit(float(fps))).drop("__lo", "__hi")


def shot_windows(samples: DataFrame, keys: list[str], fps: float, min_len: int = 8, releases: DataFrame | None = None) -> DataFrame:
    """keys, lo and hi of each key's arc: its clearest window, reached back to the release.

    With ``releases`` (keys, frame_index) the first seen one of the last 1.5 seconds begins the window instead, if the
    flight from there on is physical; else the window stays.
    """
    windows = written(W.extended_windows(samples, W.arc_windows(samples, keys, fps, min_len), keys, fps), "shot-windows")
    if releases is None:
        return windows
    seen = releases.select(*keys, "frame_index").join(samples.select(*keys, "frame_index"), [*keys, "frame_index"], "left_semi")
    named = W.earliest_release(windows, seen, keys, fps)
    fits = A.fit_arcs(_times(samples, named.where("release is not null"), keys, fps, "release"), keys)
    good = fits.where(A.is_physical(F.col("n"), F.col("z0"), F.col("min_z"))).select(*keys, F.lit(True).alias("__good"))
    out = named.join(good, keys, "left").withColumn("lo", F.when(F.col("__good"), F.col("release")).otherwise(F.col("lo")))
    return written(out.select(*keys, "lo", "hi"), "shot-windows")


def place_at(t: Column) -> tuple[Column, Column, Column]:
    """Place in feet of an arc (x0 to vz) at a time."""
    return F.col("x0") + F.col("vx") * t, F.col("y0") + F.col("vy") * t, F.col("z0") + F.col("vz") * t - 0.5 * A.GRAVITY * t * t


def _upright(camera: Column, flipped: Column) -> Column:
    """A camera with its height axis turned up, where the arc's had to be."""
    return F.when(flipped, F.transform(camera, lambda v, i: F.when(i % 4 == 2, -v).otherwise(v))).otherwise(camera)


def reconstruct(samples: DataFrame, windows: DataFrame, rims: DataFrame, cameras: DataFrame, keys: list[str], fps: float, min_len: int = 8) -> DataFrame:
    """keys and METRICS of each window with at least ``min_len`` sightings: the fitted arc, its points at the sightings (feet),
    what follows from it, and where it ends: at the rim as seen (``rims``: keys, frame_index, rim_x, rim_y, rim_r) if
    it meets that on its way down, else at the rim's height, the floor or the last sighting."""
    inside = _times(samples, windows, keys, fps)
    fits = written(A.fit_arcs(inside, keys).where(F.col("n") >= min_len), "shot-fits")
    x, y, z = place_at(F.col("t"))
    seen = inside.select(*keys, "frame_index", "t").join(fits, keys)
    each = F.sort_array(F.collect_list(F.struct("frame_index", F.array(x, y, z).alias("p"))))
    gathered = seen.groupBy(*keys).agg(each.alias("__each"), F.max("t").alias("t_seen"), F.max(z).alias("__highest"))
    out = fits.join(gathered, keys).join(windows.select(*keys, "lo", "hi"), keys)
    v = [F.col(c) for c in ("vx", "vy", "vz")]
    apex = A.apex_height(F.col("z0"), F.col("vz"), F.col("__highest"))
    angle, end = A.launch_angle(*v), A.arc_end(F.col("z0"), F.col("vz"), F.col("t_seen"))
    out = out.withColumns({"apex": apex, "speed": A.launch_speed(*v), "angle": angle, "plausible": A.is_plausible(F.col("rmse"), apex, angle), "t_end": end["t"], "how": end["how"], "frames": F.transform("__each", lambda s: s["frame_index"]), "points": F.transform("__each", lambda s: s["p"])})
    out = out.join(W.rim_targets(windows, rims, keys, samples.select(*keys, "frame_index").distinct()).drop("lo", "hi"), keys, "left")
    turned = cameras.select(*keys, "frame_index", "camera").join(out.select(*keys, "flipped"), keys).withColumn("camera", _upright(F.col("camera"), F.col("flipped")))
    hits = W.ends_at_rim(out.where("rim_x is not null").withColumn("after", F.col("t_seen")), turned, keys, fps)
    out = out.join(hits, keys, "left")
    met = F.col("t_rim").isNotNull()
    out = out.withColumns({"t_end": F.greatest(F.coalesce("t_rim", "t_end"), F.col("t_seen")), "how": F.when(met, "rim").otherwise(F.col("how"))})
    return written(out.select(*keys, *METRICS), "shots")


def _pixel(camera: Column, x: Column, y: Column, z: Column) -> Column:
    """[u, v] as whole numbers, half to even; null where the camera can't see the place."""
    u, v = W.camera_projection(camera, x, y, z)
    return F.when(u.isNotNull(), F.array(F.rint(u).cast("int"), F.rint(v).cast("int")))


def _pixels(camera: Column, times: Column) -> Column:
    """``_pixel`` of an arc (x0 to vz) at each of ``times``, step by step: each number of a place is worked out once."""

    def scales(p: Column) -> Column:
        row = lambda i: camera[4 * i] * p["x"] + camera[4 * i + 1] * p["y"] + camera[4 * i + 2] * p["z"] + camera[4 * i + 3]
        return F.struct(*(row(i).alias(n) for i, n in enumerate("uvw")))

    places = F.transform(times, lambda t: F.struct(*(c.alias(n) for n, c in zip("xyz", place_at(t), strict=True))))
    whole = lambda c: F.rint(c).cast("int")
    return F.transform(F.transform(places, scales), lambda s: F.when(F.abs(s["w"]) >= 1e-9, F.array(whole(s["u"] / s["w"]), whole(s["v"] / s["w"]))))


def overlay_frames(shots: DataFrame, cameras: DataFrame, balls: DataFrame, rims: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """keys, frame_index and what is drawn in it, for each frame from a shot's first to a little past its end that has a camera.

    arc: the arc as seen from this frame, end and end_reason, rim, ball_proj and ball_z_m while the ball is in flight, ball_meas. A
    frame meets its shot, camera, ball and rim by equality, so a shot adds its own second or two of frames.
    """
    t_end, t_seen = F.col("t_end"), F.col("t_seen")
    past = F.greatest(F.lit(int(PAST_S * fps)), F.rint((t_end - t_seen) * fps).cast("int") + 2)
    # The lists of a shot's sightings aren't drawn, so they aren't laid out over its frames.
    rows = shots.drop("frames", "points").withColumn("overlay_hi", F.col("hi") + past).withColumn("frame_index", F.explode(F.sequence(F.col("lo").cast("long"), F.col("overlay_hi").cast("long"))))
    at = [*keys, "frame_index"]
    rim = rims.select(*at, F.col("rim_x").alias("__rx"), F.col("rim_y").alias("__ry"), F.col("rim_r").alias("__rr"))
    rows = rows.join(cameras.select(*at, "camera"), at).join(rim, at, "left").join(balls.select(*at, F.col("u").alias("__u"), F.col("v").alias("__v")), at, "left")
    rows = spread(rows, *at)
    p = _upright(F.col("camera"), F.col("flipped"))
    n = F.greatest(F.lit(LEAST_PLACES), F.rint(t_end * fps * PLACES_A_FRAME).cast("int"))
    line = _pixels(F.col("__p"), F.transform(F.sequence(F.lit(0), n - 1), lambda k: t_end * k / (n - 1)))
    rows = rows.withColumn("__p", p).withColumn("__line", F.filter(line, lambda q: q.isNotNull()))
    seen_rim = F.array(F.rint("__rx").cast("int"), F.rint("__ry").cast("int"))
    last = F.try_element_at("__line", F.lit(-1))
    led = (F.col("how") == "rim") & F.col("__rx").isNotNull() & (F.size("__line") >= 2) & (distance(last[0], last[1], seen_rim[0], seen_rim[1]) > AT_RIM_PX)
    line = F.when(led, F.concat("__line", F.array(seen_rim))).otherwise(F.col("__line"))
    target = F.array(F.rint("rim_x").cast("int"), F.rint("rim_y").cast("int"))
    end = _pixel(F.col("__p"), *place_at(t_end))
    end = F.when(end.isNotNull() & (F.col("how") != "observed"), F.when((F.col("how") == "rim") & F.col("rim_x").isNotNull(), target).otherwise(end))
    t = (F.col("frame_index") - F.col("lo")) / F.lit(float(fps))
    flying, place = F.col("frame_index") <= F.col("hi"), place_at(t)
    ball = F.when(flying, _pixel(F.col("__p"), *place))
    entry = F.struct(
        F.when(F.size(line) >= 2, line).alias("arc"), end.alias("end"), F.when(end.isNotNull(), F.col("how")).alias("end_reason"),
        F.when(F.col("__rx").isNotNull(), F.array("__rx", "__ry", "__rr").cast("array<double>")).alias("rim"), ball.alias("ball_proj"),
        F.when(ball.isNotNull(), F.round(place[2] * M_PER_FT, 2)).alias("ball_z_m"), F.when(flying & F.col("__u").isNotNull(), F.array("__u", "__v").cast("array<double>")).alias("ball_meas"),
    )
    return rows.select(*at, "lo", "hi", "overlay_hi", "how", entry.alias("entry"))


def with_overlay(shots: DataFrame, cameras: DataFrame, balls: DataFrame, rims: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """``shots`` with ``overlay``: lo, hi, overlay_hi, end_reason, hud, and the entries of ``overlay_frames`` by frame number."""
    frames = overlay_frames(shots, cameras, balls, rims, keys, fps)
    entries = F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "entry"))), lambda e: F.struct(e["frame_index"].cast("string").alias("key"), e["entry"].alias("value")))
    drawn = frames.groupBy(*keys).agg(F.map_from_entries(entries).alias("__frames"), F.max("overlay_hi").alias("overlay_hi"))
    hud = F.struct(F.round(F.col("apex") * M_PER_FT, 2).alias("apex_m"), F.round("rmse", 1).alias("rmse_px"))
    overlay = F.struct("lo", "hi", "overlay_hi", F.col("how").alias("end_reason"), hud.alias("hud"), F.col("__frames").alias("frames"))
    return shots.join(drawn, keys, "left").withColumn("overlay", F.when(F.col("overlay_hi").isNotNull(), overlay)).drop("__frames", "overlay_hi")
