"""Cameras of known scenes, and shots from sightings to documents, against plain code."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators import arcs as A
from hardwood.operators import cameras as C
from hardwood.operators import homography as H
from hardwood.operators import shots3d as S
from hardwood.sources.reports import shot_documents

RNG = np.random.default_rng(4)
COURT = np.array([(x, y) for x in (4.0, 19.0, 47.0, 75.0, 90.0) for y in (3.0, 17.0, 33.0, 47.0)])
SIZE = (1280, 720)


def looking(eye, target, focal):
    z = np.array(target, float) - eye
    z /= np.linalg.norm(z)
    x = np.cross(z, [0, 0, 1.0])
    x /= np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    return C.camera_matrix(focal, np.array(SIZE) / 2, r, -r @ np.array(eye, float)), r


def seen(p, places):
    q = np.concatenate([places, np.ones((len(places), 1))], 1) @ p.T
    return q[:, :2] / q[:, 2:]


def on_court(p, noise=0.0):
    return seen(p, np.concatenate([COURT, np.zeros((len(COURT), 1))], 1)) + RNG.normal(0, noise, (len(COURT), 2))


@pytest.mark.parametrize("focal", [700.0, 1400.0, 2600.0])
def test_poses_of_known_cameras(focal):
    scenes = [looking((RNG.uniform(20, 70), RNG.uniform(-90, -30), RNG.uniform(15, 45)), (RNG.uniform(30, 60), 25, 0), focal) for _ in range(40)]
    frames, outlying = [], []
    for i, (p, _) in enumerate(scenes):
        image = on_court(p)
        frames.append((COURT, image.copy(), focal, np.array(SIZE) / 2))
        image[: i % 6] += 150
        outlying.append((COURT, image, focal, np.array(SIZE) / 2))
    for (p, r), plain, robust, i in zip(scenes, C.solve_poses(frames), C.solve_poses(outlying), range(40), strict=True):
        got = np.array(plain[3]).reshape(3, 4)
        assert np.abs(got / np.linalg.norm(got[2, :3]) - p).max() < 1e-6 * focal
        assert robust[2] == len(COURT) - i % 6 and np.abs(C.rotations(np.array([robust[0]]))[0] - r).max() < 1e-8


def test_poses_bear_noise():
    p, r = looking((47, -50, 30), (50, 25, 0), 1200.0)
    got = C.solve_poses([(COURT, on_court(p, 0.5), 1200.0, np.array(SIZE) / 2) for _ in range(30)])
    assert all(np.abs(C.rotations(np.array([g[0]]))[0] - r).max() < 0.01 for g in got)
    high = np.array([[40.0, 20.0, 10.0]])
    assert np.median([np.linalg.norm(seen(np.array(g[3]).reshape(3, 4), high) - seen(p, high)) for g in got]) < 1.0


def test_frames_that_tell_no_pose():
    c = np.array(SIZE) / 2
    line = np.stack([np.linspace(5, 80, 8), np.linspace(5, 45, 8)], 1)
    none = (None, None, 0, None)
    got = C.solve_poses([(COURT[:3], COURT[:3], 900.0, c), (line, line * 10, 900.0, c), (COURT[:0], COURT[:0], 900.0, c), (np.repeat(COURT[:1], 9, 0), np.repeat(COURT[:1], 9, 0), 900.0, c)])
    assert [tuple(g) for g in got] == [none] * 4 and C.solve_poses([]) == []
    p, _ = looking((47, -50, 30), (50, 25, 0), 900.0)
    (five,) = C.solve_poses([(COURT[[0, 3, 9, 16, 19]], on_court(p)[[0, 3, 9, 16, 19]], 900.0, c)])
    assert five[0] is None and five[3] is not None  # five points: a camera, but no pose


def test_rotation_vectors_go_there_and_back():
    for size in (1e-9, 0.3, 2.0, np.pi - 1e-9, np.pi):
        for _ in range(20):
            way = RNG.normal(size=3)
            r = C.rotations((way / np.linalg.norm(way) * size)[None])[0]
            assert np.abs(C.rotations(C.rotation_vector(r)[None])[0] - r).max() < 1e-6


def plain_candidates(h):
    m = np.array([[1, 0, -SIZE[0] / 2], [0, 1, -SIZE[1] / 2], [0, 0, 1]]) @ np.linalg.inv(h)
    a, b = m[:, 0], m[:, 1]
    both = [-(a[0] * b[0] + a[1] * b[1]) / (a[2] * b[2]), (b[0] ** 2 + b[1] ** 2 - a[0] ** 2 - a[1] ** 2) / (a[2] ** 2 - b[2] ** 2)]
    return [f for f in both if f > 0]


def test_focal_lengths_by_plain_median(spark):
    rows, want = [], {}
    for video, focal, n in (("a", 800.0, 40), ("b", 1500.0, 33), ("c", 1000.0, 12)):
        found = []
        for i in range(n):
            p, _ = looking((40 + i * 0.3, -50, 30), (45, 25, 0), focal)
            h = np.linalg.inv(p[:, [0, 1, 3]] + RNG.normal(0, 1e-3, (3, 3)))
            rows.append((video, 2 * i, (h / h[2, 2]).ravel().tolist(), 1280.0, 720.0))
            found.append(plain_candidates(h))
        some = [(i, c) for i, c in enumerate(found) if c][:30]
        if len(some) == 30:
            want[video] = (float(np.sqrt(np.median([f for _, c in some for f in c]))), 2 * some[-1][0])
    planes = spark.createDataFrame(rows, "video_id string, frame_index long, h array<double>, width double, height double")
    got = {r.video_id: (r.focal, r.calibrated_at) for r in C.focal_lengths(planes).collect()}
    assert got.keys() == want.keys() == {"a", "b"}
    assert all(abs(got[v][0] - want[v][0]) < 1e-3 and got[v][1] == want[v][1] for v in want)
    assert abs(got["a"][0] - 800) < 20 and C.focal_lengths(planes.limit(0)).count() == 0


POINTS = "array<struct<kp_idx:int,x:double,y:double,valid:boolean,wx:double,wy:double>>"


def court_frames(spark, images):
    rows = []
    for video, frames in images.items():
        for i, image in enumerate(frames):
            points = None if image is None else [(k, float(x), float(y), True, *map(float, COURT[k])) for k, (x, y) in enumerate(image)]
            rows.append((video, i, *SIZE, points))
    return spark.createDataFrame(rows, f"video_id string, frame_index long, width int, height int, points {POINTS}").repartition(3)


def test_court_cameras_follow_predict_and_fall_back(spark):
    ps = [looking((47, -50, 30), (47 + max(i - 35, 0) * 0.05, 25, 0), 1100.0)[0] for i in range(100)]
    images = [on_court(p) for p in ps]
    gone = [*range(50, 53), *range(60, 95)]
    for i in gone:
        images[i] = None
    frames = court_frames(spark, {"a": images, "still": images[:20], "none": [None] * 3})
    got = {(r.video_id, r.frame_index): r for r in C.court_cameras(frames).collect()}
    assert len(got) == 123
    a = [got["a", i] for i in range(100)]
    assert [r.camera is not None for r in a] == [i >= 30 and not 90 <= i < 95 for i in range(100)]
    assert [r.cached for r in a if r.camera is not None] == [i in gone for i in range(30, 100) if not 90 <= i < 95]
    places = np.concatenate([COURT, np.full((len(COURT), 1), 8.0)], 1)
    for i in [*range(30, 60), *range(95, 100)]:
        assert np.abs(seen(np.array(a[i].camera).reshape(3, 4), places) - seen(ps[i], places)).max() < (6 if i < 60 else 12)
        assert np.abs(H.projected(np.array(a[i].h).reshape(3, 3), on_court(ps[i])) - COURT).max() < 1.5
    assert all(r.camera is None for k, r in got.items() if k[0] != "a") and got["still", 10].h is not None and got["none", 1].h is None
    direct = {r.frame_index: np.array(r.camera).reshape(3, 4) for r in C.frame_cameras(frames).collect()}
    assert sorted(direct) == [i for i in range(29, 100) if i not in gone]
    assert max(np.abs(seen(m, places) - seen(ps[i], places)).max() for i, m in direct.items()) < 0.01


def test_poses_are_solved_together_and_in_many_tasks(spark):
    """A video's frames are dealt over tasks, odd points are passed over, and a frame's pose takes a fraction of a millisecond."""
    p, _ = looking((47, -50, 30), (50, 25, 0), 1000.0)
    image = on_court(p)
    good = [(k, float(x), float(y), True, *map(float, COURT[k])) for k, (x, y) in enumerate(image)]
    odd = [(90, 1.0, 1.0, None, 5.0, 5.0), (91, 1.0, 1.0, False, 5.0, 5.0), (92, None, None, False, None, None)]
    rows = [("a", i, *SIZE, None if i % 10 == 3 else [] if i % 10 == 4 else good[: 6 + i % 10] + odd) for i in range(400)]
    frames = spark.createDataFrame(rows, f"video_id string, frame_index long, width int, height int, points {POINTS}").repartition(3)
    focals = spark.createDataFrame([("a", 1000.0, 10)], "video_id string, focal double, calibrated_at long")
    got = C.frame_poses(frames, focals).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 3 and len(got) == 400
    for r in got:
        n = 0 if r.frame_index % 10 in (3, 4) else 6 + r.frame_index % 10
        assert (r.camera is not None) == (r.frame_index >= 10 and n >= 4) and (r.rotation is not None) == (r.frame_index >= 10 and n >= 6)
        assert r.camera is None or np.abs(np.array(r.camera).reshape(3, 4) - p).max() < 1e-5 * np.abs(p).max()
        assert r.inliers in ((n,) if r.rotation is not None else (0, None))
    many, times = [(COURT[:10], image[:10], 1000.0, np.array(SIZE) / 2)] * 300, []
    for _ in range(5):
        start = time.perf_counter()
        C.solve_poses(many)
        times.append(time.perf_counter() - start)
    assert min(times) / 300 < 0.0006


def test_filter_of_poses_by_plain_recursion():
    s, at, spread = C._filter_start(), None, None
    move = np.block([[np.eye(6), np.eye(6)], [np.zeros((6, 6)), np.eye(6)]])
    q, sight = np.diag([1e-4] * 3 + [1e-2] * 3 + [1e-4] * 3 + [1e-2] * 3), np.diag([1e-3] * 3 + [1e-1] * 3)
    look = np.eye(6, 12)
    for i in range(40):
        pose = None if i % 7 == 5 else RNG.normal(size=6)
        if at is None:
            at, spread = np.concatenate([pose, np.zeros(6)]), np.eye(12)
        else:
            at, spread = move @ at, move @ spread @ move.T + q
            if pose is not None:
                gain = spread @ look.T @ np.linalg.inv(look @ spread @ look.T + sight)
                at, spread = at + gain @ (pose - look @ at), (np.eye(12) - gain @ look) @ spread
        assert np.allclose(C.filter_pose(s, pose), at[:6])


# --- Arcs and shots -------------------------------------------------------------------------

STILL, _ = looking((-25, 25, 35), (40, 25, 7), 1400.0)


def thrown(t, x0=35.0, vx=6.0, y0=25.0, vy=0.0, z0=7.0, vz=22.0):
    t = np.asarray(t, float)
    return np.stack([x0 + vx * t, y0 + vy * t, z0 + vz * t - 0.5 * A.GRAVITY * t * t], -1)


def test_many_arcs_equal_one_by_one(spark):
    rows, want = [], {}
    for k in range(60):
        n = int(RNG.integers(2, 30))
        t = np.sort(RNG.uniform(0, 0.9, n))
        p = STILL * np.array([1, 1, -1, 1]) if k % 5 == 0 else STILL
        uv = seen(STILL, thrown(t, vz=18 + k / 10)) + RNG.normal(0, 1, (n, 2))
        rows += [(k, float(a), float(u), float(v), p.ravel().tolist()) for a, (u, v) in zip(t, uv, strict=True)]
        if n >= 3:
            cams = np.repeat(STILL[None], n, 0)
            lines = np.concatenate([np.stack([(c[:2] - x[:, None] * c[2:])]) for c, x in zip(cams, uv, strict=True)]).reshape(-1, 4)
            when = np.repeat(t, 2)
            design = np.stack([lines[:, 0], lines[:, 0] * when, lines[:, 1], lines[:, 1] * when, lines[:, 2], lines[:, 2] * when], 1)
            want[k] = (np.linalg.lstsq(design, 0.5 * A.GRAVITY * when**2 * lines[:, 2] - lines[:, 3], rcond=None)[0], n, k % 5 == 0)
    rows += [(0, None, 1.0, 1.0, STILL.ravel().tolist()), (0, 0.5, float("nan"), 1.0, STILL.ravel().tolist()), (99, 0.1, 1.0, 1.0, None)]
    got = {r.k: r for r in A.fit_arcs(spark.createDataFrame(rows, "k long, t double, u double, v double, camera array<double>"), ["k"]).collect()}
    assert got.keys() == want.keys()
    for k, (p, n, flipped) in want.items():
        assert got[k].n == n and got[k].flipped == flipped
        if n >= 6:
            assert np.abs(np.array([got[k][c] for c in ("x0", "vx", "y0", "vy", "z0", "vz")]) - p).max() < 1e-5


def scene(spark, release=None, rim_at=1.2):
    frames = np.arange(10, 38)
    uv = seen(STILL, thrown((frames - 10) / 30))
    balls = spark.createDataFrame([("c", int(f), float(u), float(v)) for f, (u, v) in zip(frames, uv, strict=True) if f != 12], "clip string, frame_index long, u double, v double")
    cameras = spark.createDataFrame([("c", f, (STILL * (1 + f / 100)).ravel().tolist()) for f in range(60) if f != 41], "clip string, frame_index long, camera array<double>")
    at = seen(STILL, thrown([rim_at]))[0]
    rims = spark.createDataFrame([("c", f, float(at[0]), float(at[1]), 9.0) for f in (15, 18, 12, 39)], "clip string, frame_index long, rim_x double, rim_y double, rim_r double")
    releases = None if release is None else spark.createDataFrame([("c", f) for f in release], "clip string, frame_index long")
    samples = S.shot_samples(balls, cameras, ["clip"])
    windows = S.shot_windows(samples, ["clip"], 30, 8, releases)
    return S.reconstruct(samples, windows, rims, cameras, ["clip"], 30), cameras, balls, rims


def test_a_shot_from_sightings_to_its_document(spark):
    shots, cameras, balls, rims = scene(spark)
    (r,) = shots.collect()
    assert (r.lo, r.hi, r.n, r.how, r.plausible) == (10, 37, 27, "rim", True) and r.rmse < 1e-6 and abs(r.vz - 22) < 1e-6
    assert r.frames == [f for f in range(10, 38) if f != 12] and abs(r.apex - (7 + 22**2 / 2 / A.GRAVITY)) < 1e-6
    at = seen(STILL, thrown([1.2]))[0]
    steps = np.linspace(max(27 / 30, 22 / A.GRAVITY) + 1e-6, (22 + np.sqrt(22**2 - 2 * A.GRAVITY * 3)) / A.GRAVITY, 400)
    first = next(t for t in steps if np.hypot(*(np.rint(seen(STILL, thrown([t]))[0]) - at)) <= 1.25 * 9)
    assert abs(r.t_end - first) < 1e-6
    doc = json.loads(shot_documents(S.with_overlay(shots, cameras, balls, rims, ["clip"], 30).withColumn("fps", F.lit(30.0))).first().value)
    over = doc["overlay"]
    last = 37 + max(12, round((first - 0.9) * 30) + 2)
    assert (over["lo"], over["hi"], over["overlay_hi"], over["end_reason"]) == (10, 37, last, "rim")
    assert sorted(map(int, over["frames"])) == [f for f in range(10, last + 1) if f != 41]
    line = [[round(u), round(v)] for u, v in seen(STILL, thrown(np.linspace(0, first, max(90, round(first * 60)))))]
    goal = [round(at[0]), round(at[1])]
    for f, e in ((int(k), e) for k, e in over["frames"].items()):
        led = f in (15, 18, 12, 39) and bool(np.hypot(line[-1][0] - goal[0], line[-1][1] - goal[1]) > 4)
        assert e["arc"] == line + [goal] * led and e["end"] == goal and e["end_reason"] == "rim"
        assert ("rim" in e) == (f in (15, 18, 12, 39)) and ("ball_meas" in e) == (f <= 37 and f != 12)
        if f <= 37:
            place = thrown([(f - 10) / 30])
            assert e["ball_proj"] == [round(v) for v in seen(STILL, place)[0]] and e["ball_z_m"] == round(float(place[0, 2] * 0.3048), 2)
        else:
            assert "ball_proj" not in e


def test_releases_begin_a_window_only_if_the_flight_is_physical(spark):
    assert scene(spark, [14, 19])[0].first().lo == 14
    assert scene(spark, [12, 55])[0].first().lo == 10  # not seen, and outside
    assert scene(spark, [36])[0].count() == 1 and scene(spark, [36])[0].first().lo == 10  # too few sightings from there on
    assert scene(spark, [])[0].first().lo == 10


def test_shots_without_rims_or_sightings(spark):
    shots, cameras, balls, rims = scene(spark, rim_at=40.0)
    (r,) = shots.collect()
    assert r.how == "rim" and abs(r.t_end - (22 + np.sqrt(22**2 - 2 * A.GRAVITY * 3)) / A.GRAVITY) < 1e-6
    none = S.shot_samples(balls.limit(0), cameras, ["clip"])
    windows = S.shot_windows(none, ["clip"], 30)
    empty = S.reconstruct(none, windows, rims, cameras, ["clip"], 30)
    assert empty.count() == 0 and S.with_overlay(empty, cameras, balls, rims, ["clip"], 30).count() == 0


def test_pixels_of_an_arc_are_those_place_by_place(spark):
    """The drawn places equal those worked out one by one, and a shot's frames are dealt over tasks."""
    keys = "id clip, 10 lo, 40 hi, 20D + id % 7 x0, 9D - id % 5 vx, 6D y0, 2D vy, 7D z0, 21D + id % 3 vz, 1.0D + id / 40 t_end, 1.0D t_seen, false flipped, 'rim' how, null rim_x, null rim_y, array(1) frames, array(1) points"
    shots = spark.sql(f"select {keys} from range(24)")
    still = [2000.0, 640.0, 0.0, 38400.0, 0.0, 360.0, -2000.0, 36600.0, 0.0, 1.0, 0.0, 60.0]
    cameras = spark.range(24).select(F.col("id").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("frame_index"), F.array(*map(F.lit, still)).alias("camera"))
    none = spark.sql("select 1L clip, 1 frame_index, 1D rim_x, 1D rim_y, 1D rim_r, 1D u, 1D v").limit(0)
    rows = S.overlay_frames(shots, cameras, none, none, ["clip"], 30.0)
    drawn = rows.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in drawn}) > 4 and "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
    want = shots.withColumn("camera", F.array(*map(F.lit, still))).withColumn("n", F.greatest(F.lit(90), F.rint(F.col("t_end") * 60).cast("int")))
    want = want.select("clip", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k", "_"), "n", *shots.columns[3:10], "camera")
    want = want.select("clip", "k", S._pixel(F.col("camera"), *S.place_at(F.col("t_end") * F.col("k") / (F.col("n") - 1))).alias("p")).orderBy("clip", "k").collect()
    by_clip = {}
    for r in want:
        by_clip.setdefault(r.clip, []).append(r.p)
    assert all(r.entry.arc == by_clip[r.clip] for r in drawn) and len(drawn) == 24 * 40
