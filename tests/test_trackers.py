"""Trackers, plane estimates and arc windows against plain code and known scenes."""

import time

import numpy as np
from pyspark.sql import functions as F

from hardwood.operators import arcs as A
from hardwood.operators import homography as H
from hardwood.operators import trackers as T
from hardwood.operators import windows as W


def play(start, step, rows):
    s = start()
    return [step(s, {"video_id": "v", "frame_index": i, **r}) for i, r in enumerate(rows)]


def seen(x, y, confidence=0.9):
    return {"candidates": [{"x1": x - 5.0, "y1": y - 4.0, "x2": x + 5.0, "y2": y + 4.0, "confidence": confidence}]}


NONE = {"candidates": None}


def test_filtered_ball_follows_a_line_and_holds_over():
    got = play(T.filter_start, T.filter_step, [seen(10.0 * k, 50.0) for k in range(12)] + [NONE] * 19 + [seen(0.0, 0.0)])
    assert abs((got[11][0]["x1"] + got[11][0]["x2"]) / 2 - 110) < 3 and not got[11][0]["predicted"]
    assert all(g[0]["predicted"] and abs(g[0]["x2"] - g[0]["x1"] - 10) < 1e-9 for g in got[12:30])
    assert got[30] == [] and got[31][0]["x1"] == -5.0


def test_filtered_ball_prefers_the_gate_and_falls_back():
    far = {"candidates": seen(900.0, 900.0, 0.95)["candidates"] + seen(12.0, 10.0, 0.3)["candidates"]}
    assert play(T.filter_start, T.filter_step, [seen(10.0, 10.0), far])[1][0]["confidence"] == 0.3
    assert play(T.filter_start, T.filter_step, [seen(10.0, 10.0), seen(900.0, 900.0)])[1][0]["confidence"] == 0.9
    assert play(T.filter_start, T.filter_step, [seen(10.0, 10.0, 0.2), seen(10.0, 10.0, None)])[1][0]["confidence"] == 1.0


def test_no_flight_starts_anew_as_a_plain_fit_says():
    rng = np.random.default_rng(1)
    for spread in (0.5, 60.0, 6.0, 12.0):
        rows = [seen(5.0 * k + rng.normal(0, spread), 300 - 20.0 * k + 0.5 * k * k + rng.normal(0, spread)) for k in range(45)]
        free = play(T.filter_start, lambda s, r: T.filter_step(s, r, check=False), rows)
        got = play(T.filter_start, T.filter_step, rows)
        x, y = (np.array([(g[0][f"{c}1"] + g[0][f"{c}2"]) / 2 for g in free]) for c in "xy")
        cut = None
        for n in (15, 30, 45):
            t = np.arange(1, n + 1)
            worst = max(((np.polyval(np.polyfit(t, p[:n], d), t) - p[:n]) ** 2).mean() for p, d in ((x, 1), (y, 2)))
            if worst > T.MOST_ERROR:
                cut = n - 1
                break
        assert (next((i for i, g in enumerate(got) if not g), None)) == cut


def test_filtered_ball_on_spark(spark):
    rows = [(v, i, [(float(i), 0.0, i + 9.0, 8.0, 0.5)]) for v in "ab" for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, candidates array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>")
    assert T.filter_ball(df).count() == 10 and T.filter_ball(df.limit(0)).count() == 0


def test_boxes_are_followed(spark):
    a, b, c = (0.0, 0.0, 10.0, 10.0), (100.0, 0.0, 110.0, 10.0), (2.0, 0.0, 12.0, 10.0)
    rows = [("v", 0, [a, b]), ("v", 1, [b, c]), ("v", 2, [b]), ("v", 3, [a, b]), ("v", 4, []), ("v", 5, [b]), ("w", 0, [b])]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {(r.video_id, r.frame_index, r.det_idx): r.track_id for r in T.follow_boxes(df).collect()}
    assert got == {("v", 0, 0): 1, ("v", 0, 1): 2, ("v", 1, 0): 2, ("v", 1, 1): 1, ("v", 2, 0): 2, ("v", 3, 0): 3, ("v", 3, 1): 2, ("v", 5, 0): 4, ("w", 0, 0): 1}


def points(shift, n=6, valid=True):
    return {"points": [{"kp_idx": k, "x": 50.0 * k + shift, "y": 30.0 * (k % 3), "valid": valid} for k in range(n)]}


def test_camera_segments():
    moved = lambda rows: [g[0]["moved"] for g in play(T.segment_start, T.segment_step, rows)]
    assert moved([points(0), points(0, 0), points(20), points(41)]) == [False, False, False, True]
    assert moved([points(5.0 * k) for k in range(14)]) == [False] * 6 + [True] + [False] * 6 + [True]
    assert moved([points(0), points(0, 2), points(0)]) == [False, True, True]
    assert [g[0]["segment"] for g in play(T.segment_start, T.segment_step, [points(0), points(50), points(50)])] == [0, 1, 1]


TRUE = np.array([[0.05, 0.01, -4.0], [0.002, 0.08, -6.0], [0.00002, 0.0004, 1.0]])


def scene(noise=0.0, wrong=0, n=30, seed=0):
    rng = np.random.default_rng(seed)
    image = rng.uniform((100, 100), (1800, 900), (n, 2))
    world = H.projected(TRUE, image)
    world[:wrong] += rng.uniform(20, 60, (wrong, 2))
    return image + rng.normal(0, noise, image.shape), world


def test_robust_fit_ignores_wrong_points():
    image, world = scene(0.5, 9)
    h, inliers, error, why = H.robust_fit(image, world)
    assert why is None and inliers == 21 and error < 2
    assert np.abs(H.projected(h, image[9:]) - world[9:]).max() < 0.2
    assert H.robust_fit(image, world)[0].tolist() == h.tolist()
    assert H.robust_fit(image[:4], world[:4])[3] == "few_points"
    assert H.robust_fit(image, world * 0.01)[3] == "low_span"
    line = np.stack([np.linspace(0, 90, 20), np.linspace(0, 40, 20)], 1)
    assert H.robust_fit(np.random.default_rng(3).uniform(0, 1000, (20, 2)), line)[3] is not None


def frame(image, world):
    return {"points": [{"kp_idx": k, "x": x, "y": y, "valid": True, "wx": u, "wy": v} for k, ((x, y), (u, v)) in enumerate(zip(image.tolist(), world.tolist(), strict=True))]}


def test_planes_are_held_over_and_decay(spark):
    good, none = frame(*scene(0.3)), {"points": []}
    got = [g[0] for g in play(H.plane_start, H.plane_step, [good] * 8 + [none] * 3 + [good])]
    assert all(not g["cached"] and g["h"] for g in got[:8]) and got[7]["inliers"] == 240
    single = [g[0] for g in play(H.plane_start, H.plane_step, [good] + [none] * 31)]
    assert [g["cached"] for g in single] == [False] + [True] * 30 + [False] and single[31]["h"] is None
    assert abs(single[15]["confidence"] - single[0]["confidence"] * 0.5) < 1e-12 and abs(single[30]["confidence"]) < 1e-12
    rows = [("v", i, [tuple(p.values()) for p in good["points"]]) for i in range(3)]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, points array<struct<kp_idx:int,x:double,y:double,valid:boolean,wx:double,wy:double>>")
    assert [r.reason for r in H.court_planes(df).collect()] == [None] * 3


def shots(spark):
    """One throw a clip: sightings by a still camera, before it a hand at rest, one frame unseen."""
    m = np.array([[2000.0, 640.0, 0.0, 38400.0], [0.0, 360.0, -2000.0, 36600.0], [0.0, 1.0, 0.0, 60.0]])
    rows = []
    for clip, vz in (("a", 24.0), ("b", 26.0)):
        for f in range(60):
            t = (f - 20) / 30
            x, y, z = (10 + 8 * t, 5 + 2 * t, 7 + vz * t - 0.5 * A.GRAVITY * t * t) if t >= 0 else (10.0 - 0.2 * (20 - f), 5.0, 4.5)
            u, v, w = m @ (x, y, z, 1.0)
            if f != 30:
                rows.append((clip, f, float(u / w), float(v / w), m.ravel().tolist()))
    return spark.createDataFrame(rows, "clip string, frame_index long, u double, v double, camera array<double>"), m


def plain_window(rows, fps, min_len):
    half, best = max(min_len // 2, round(0.5 * fps)), None
    runs, last = [], None
    for f, v in sorted(rows):
        if last is None or f != last + 1:
            runs.append([])
        runs[-1].append((f, v))
        last = f
    for run in runs:
        ys = np.array([v for _, v in run])
        i, j = max(0, ys.argmin() - half), min(len(run) - 1, ys.argmin() + half)
        if len(run) < min_len or j - i + 1 < min_len:
            continue
        t, y = np.arange(j - i + 1), ys[i : j + 1]
        c = np.polyfit(t, y, 2)
        rms = np.sqrt(((np.polyval(c, t) - y) ** 2).mean())
        if c[0] > 0 and 0 <= -c[1] / (2 * c[0]) <= len(t) - 1 and rms <= 22 and np.ptp(y) >= 60 and (best is None or np.ptp(y) > best[0]):
            best = (np.ptp(y), run[i][0], run[j][0])
    return best and best[1:]


def test_arc_windows_by_plain_code(spark):
    samples, _ = shots(spark)
    got = {r.clip: (r.lo, r.hi) for r in W.arc_windows(samples, ["clip"], 30, 8).collect()}
    rows = samples.collect()
    assert got == {c: plain_window([(r.frame_index, r.v) for r in rows if r.clip == c], 30, 8) for c in "ab"} and all(got.values())
    assert W.arc_windows(samples.limit(0), ["clip"], 30, 8).count() == 0


def test_windows_reach_back_to_the_release(spark):
    samples, _ = shots(spark)
    windows = W.arc_windows(samples, ["clip"], 30, 8)
    got = {r.clip: r.lo for r in W.extended_windows(samples, windows, ["clip"], 30).collect()}
    assert all(15 <= lo <= 20 for lo in got.values()) and len(got) == 2
    releases = spark.createDataFrame([("a", 19), ("a", 22), ("a", 1), ("c", 20)], "clip string, frame_index long")
    assert {r.clip: r.release for r in W.earliest_release(windows, releases, ["clip"], 30).collect()} == {"a": 19, "b": None}


def test_arcs_end_at_the_seen_rim(spark):
    samples, m = shots(spark)
    t, vz = 1.3, 24.0
    place = np.array([10 + 8 * t, 5 + 2 * t, 7 + vz * t - 0.5 * A.GRAVITY * t * t, 1.0])
    u, v, w = m @ place
    rows = [("a", 20, 10.0, 8.0, 5.0, 2.0, 7.0, vz, 0.9, 1.5, float(u / w), float(v / w), 12.0), ("b", 20, 10.0, 8.0, 5.0, 2.0, 7.0, vz, 0.9, 1.5, 5000.0, 0.0, 12.0)]
    arcs = spark.createDataFrame(rows, "clip string, lo long, x0 double, vx double, y0 double, vy double, z0 double, vz double, after double, t_end double, rim_x double, rim_y double, rim_r double")
    got = {r.clip: r.t_rim for r in W.ends_at_rim(arcs, samples.select("clip", "frame_index", "camera"), ["clip"], 30).collect()}
    want = None
    for s in np.linspace(0.9 + 1e-6, 1.5, 400):
        a, b, c = m @ (10 + 8 * s, 5 + 2 * s, 7 + vz * s - 0.5 * A.GRAVITY * s * s, 1.0)
        if want is None and np.hypot(round(a / c) - u / w, round(b / c) - v / w) <= 15:
            want = s
    assert list(got) == ["a"] and abs(got["a"] - want) < 1e-9


def test_rim_targets(spark):
    windows = spark.createDataFrame([("a", 10, 20), ("b", 10, 20)], "clip string, lo long, hi long")
    rims = [("a", 11, 1.0, 2.0, 8.0), ("a", 12, 3.0, 4.0, 9.0), ("a", 50, 90.0, 90.0, 90.0), ("b", 12, 5.0, 5.0, 5.0), ("b", 40, 7.0, 7.0, 7.0), ("b", 41, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rims, "clip string, frame_index long, rim_x double, rim_y double, rim_r double")
    got = {r.clip: (r.rim_x, r.rim_y, r.rim_r) for r in W.rim_targets(windows, df, ["clip"]).collect()}
    assert got == {"a": (2.0, 3.0, 8.5), "b": (7.0, 7.0, 7.0)}


def test_camera_projection(spark):
    m = F.array(*map(F.lit, [1.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 1.0, 0.0]))
    u, v = W.camera_projection(m, F.lit(4.0), F.lit(5.0), F.col("z"))
    rows = spark.createDataFrame([(2.0,), (0.0,)], "z double").select(u.alias("u"), v.alias("v")).collect()
    assert [(r.u, r.v) for r in rows] == [(3.0, 4.0), (None, None)]


def test_samples_of_four_by_plain_solving():
    """Matrices through four points, and who is within reach of them, as solving each sample alone tells."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 4, 2)), rng.normal(size=(40, 4, 2))
    h = H.through_four(a, b)
    assert max(np.abs(H.projected(m, p) - q).max() for m, p, q in zip(h, a, b, strict=True)) < 1e-6
    places, image = rng.normal(size=(30, 2)), rng.normal(size=(30, 2))
    want = np.linalg.norm(H.projected(h, places) - image, axis=-1) <= 0.7
    assert (H.within(h, places, image, 0.7) == want).all() and want.any() and not want.all()
    twice = H.through_four(a[:1][:, [0, 0, 1, 2]], b[:1][:, [0, 0, 1, 2]])
    assert not H.within(twice, places, image, 1e9).any()  # a point drawn twice tells no matrix


def test_a_pool_of_frames_is_fitted_fast():
    """A pool of 25 frames takes some 0.7 ms on a core, where solving 256 samples one by one took 5 to 30."""
    world = np.array([(4.0 + k * 9, 5.0 + (k * 7) % 41) for k in range(10)])
    image = H.projected(np.array([[18, 4, 120], [0.5, 9, 200], [0.0004, 0.002, 1]]), world)
    image[[3, 8]] += (300, 0)
    pool = np.concatenate([image] * 25), np.concatenate([world] * 25)
    times = []
    for _ in range(30):
        start = time.perf_counter()
        h, inliers, error, why = H.robust_fit(*pool)
        times.append(time.perf_counter() - start)
    assert inliers == 200 and error < 1e-9 and why is None and np.abs(H.projected(h, image[:3]) - world[:3]).max() < 1e-6
    assert min(times) < 0.003


def test_videos_of_few_bytes_stay_in_tasks_of_their_own(spark):
    """Forty short videos are dealt over all tasks; Spark alone would merge their few bytes into fewer."""
    df = spark.range(40).select(F.col("id").cast("string").alias("video_id"), F.lit(0).cast("long").alias("frame_index"), F.lit(None).cast("array<struct<kp_idx:int,x:double,y:double,valid:boolean,wx:double,wy:double>>").alias("points"))
    got = H.court_planes(df).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r.task for r in got}) == 8
