"""Releases against a plain loop; keypoints and positions step by step."""

import math
import random

from hardwood.operators import smoothing as M
from tests.test_state import play


def plain_releases(rows):
    """Frame by frame: what the windows and the cooldown say together."""
    out, past, free = [], [], 0
    for f, wrists, ball in rows:
        d = None if ball is None or not wrists else min(math.dist(w, ball) for w in wrists)
        past.append((d, ball))
        last = past[-4:]
        if f < free or len(last) < 4 or any(x is None for x, _ in last):
            continue
        ds = [x for x, _ in last]
        held = any(x is not None and x <= 70 for x, _ in past[-10:])
        if held and ds == sorted(set(ds)) and ds[-1] >= 45 and last[0][1][1] - ball[1] >= 18:
            out.append(f)
            free = f + 25
    return out


def frames(spark, rows, video="a"):
    point = lambda p: None if p is None else {"x": float(p[0]), "y": float(p[1])}
    data = [(video, f, None if w is None else [point(p) for p in w], point(b)) for f, w, b in rows]
    return spark.createDataFrame(data, "video_id string, frame_index long, wrists array<struct<x:double,y:double>>, ball struct<x:double,y:double>")


def test_releases_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows, y = [], 400.0
    for f in range(400):
        y = y - rng.choice([0, 14, 28, 28]) if rng.random() < 0.8 else 400.0
        rows.append((f, rng.choice([[(500, 400)], [(500, 400)], [(500, 400), (520, 390)], [(500, 400)], []]) if f % 9 == 0 else [(500, 400)], None if f % 31 == 0 else (505, y)))
    want = plain_releases(rows)
    assert len(want) > 3
    assert sorted(r.frame_index for r in M.releases(frames(spark, rows)).collect()) == want


def test_releases_of_odd_frames(spark):
    bounce = [(f, [(500, 400)], (500, 400 + 30 * f)) for f in range(8)]
    assert M.releases(frames(spark, bounce)).count() == 0
    never_held = [(f, [(500, 400)], (900, 600 - 30 * f)) for f in range(8)]
    assert M.releases(frames(spark, never_held)).count() == 0
    assert M.releases(frames(spark, [(0, None, None), (1, [], (1, 1))])).count() == 0
    assert M.releases(frames(spark, [])).count() == 0


def test_keypoint_refuses_a_jump_then_starts_anew():
    at = lambda x, c=0.9: {"x": x, "y": 0.0, "confidence": c}
    got = play(M.keypoint_start, M.keypoint_step, [at(0.0), at(10.0), at(200.0), at(200.0), at(210.0, 0.1), at(None)])
    assert [r["valid"] for r in got] == [True, True, False, True, False, False]
    assert [r["x"] for r in got] == [0.0, 3.0, 3.0, 200.0, 200.0, 200.0] and got[-1]["confidence"] == 0.0
    assert play(M.keypoint_start, M.keypoint_step, [at(None)]) == []


def player(k, x, team=None):
    return {"track_id": k, "team": team, "x_ft": x, "y_ft": 0.0}


def test_positions_hold_over_refuse_and_take_over():
    rows = [{"players": [player(1, 0.0, "white")]}, {"players": [player(1, 2.0)]}, {"players": [player(1, 50.0)]}, {"players": None}]
    got = play(M.position_start, M.position_step, rows)
    assert [round(r["x_ft"], 6) for r in got] == [0.0, 0.7, 0.7, 0.7] and [r["missing"] for r in got] == [0, 0, 1, 2]
    rows = [{"players": [player(1, 0.0, "white"), player(2, 1.0, "dark")]}, {"players": None}, {"players": [player(3, 0.5, "white")]}]
    assert [r["track_id"] for r in play(M.position_start, M.position_step, rows) if r["frame_index"] == 2] == [2, 3]
    gone = play(M.position_start, M.position_step, [{"players": [player(1, 0.0)]}] + [{"players": None}] * 30)
    assert len(gone) == 21


def test_release_events_judge_all_hands_of_a_frame(spark):
    from hardwood.plans import queries as Q
    from tests.conftest import SF

    at = {}
    for r in Q.players(spark, SF).collect():
        at.setdefault(r.frame_index, {})[r.track_id] = (r.x_ft * 10, r.y_ft * 10)
    videos, one = {}, {}
    for f, hands in sorted(at.items()):
        own, other, s = hands.get(f // 12 % 10), hands.get((f // 12 + 1) % 10), max(f % 12 - 6, 0)
        ball = None
        if own and other and f % 12 != 11:
            ball = (own[0] + (other[0] - own[0]) * (s / 4), own[1] + (other[1] - own[1]) * (s / 4)) if f // 12 % 2 else (own[0] + 10, own[1] - s * 30)
        for rows, wrists in ((videos, list(hands.values())), (one, [own])):
            rows.setdefault(f // 500, []).append((f % 500, wrists, ball))
    want = {(f"v{v}", 500 * v + f) for v, rows in videos.items() for f in plain_releases(rows)}
    assert want and want != {(f"v{v}", 500 * v + f) for v, rows in one.items() for f in plain_releases(rows)}
    assert {(r.video_id, r.frame_index) for r in Q.release_events(spark, SF).collect()} == want


def test_roster_names_keep_every_track_and_miss_by_null(spark):
    from hardwood.operators.joins import roster_names

    tracks = spark.createDataFrame([(1, "white", 7), (2, "white", 8), (3, "dark", 7), (4, None, 7)], "track_id long, team string, number int")
    roster = spark.createDataFrame([("white", 7, "a"), ("white", 9, "b")], "team string, number int, name string")
    assert sorted((r.track_id, r.name) for r in roster_names(tracks, roster).collect()) == [(1, "a"), (2, None), (3, None), (4, None)]


def test_keypoints_stream_in_batches_with_their_state(spark):
    rng = random.Random(7)
    rows = {k: [{"frame_index": f, "x": rng.choice([None, rng.uniform(0, 90)]), "y": rng.uniform(0, 9), "confidence": rng.random()} for f in range(100)] for k in range(5)}
    data = [("v", k, r["frame_index"], r["x"], r["y"], r["confidence"]) for k, rs in rows.items() for r in rs]
    rng.shuffle(data)
    points = spark.createDataFrame(data, "video_id string, kp_idx int, frame_index long, x double, y double, confidence double")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        out = M.steady_keypoints(points)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = sorted((r.kp_idx, r.frame_index, r.x, r.confidence, r.valid) for r in out.collect())
    finally:
        spark.conf.set(batch, before)
    assert got == sorted((k, r["frame_index"], r["x"], r["confidence"], r["valid"]) for k, rs in rows.items() for r in play(M.keypoint_start, M.keypoint_step, rs))
