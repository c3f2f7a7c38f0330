"""State machines by scenario and against plain loops; arcs, matching and greedy operators by plain code."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators import arcs as A
from hardwood.operators import joins as J
from hardwood.operators import sequences as Q
from hardwood.operators import state as K
from tests.test_state import near, play, shot


def held(rows, **how):
    return [r["possessor_track_id"] for r in play(K.possession_start, K.possession_step, rows, **how)]


def test_a_candidate_ends_the_count_of_loose_frames():
    assert held([near((1, 0.0))] * 3 + [near()] * 3 + [near((2, 0.0))] + [near()] * 2)[-1] == 1


def test_predicted_ball_keeps_a_holder_who_is_any_candidate():
    rows = [near((1, 0.0))] * 3 + [near((2, 0.0), (1, 0.3)) | {"predicted": True}] * 8
    assert held(rows)[-1] == 1
    assert held([near((1, 0.0)) | {"predicted": True}] * 5) == [None] * 5


def test_last_holder_returns_at_once():
    rows = [near((1, 0.0))] * 3 + [near((2, 0.0))] * 3 + [near()] * 5 + [near((2, 0.0))]
    assert held(rows)[-2:] == [None, 2]


def test_ties_go_to_who_moves_with_the_ball():
    c = [{"track_id": 1, "score": 0.0, "align": -3.0}, {"track_id": 2, "score": 0.02, "align": 5.0}, {"track_id": 3, "score": 0.4, "align": 9.0}]
    assert held([{"candidates": c}], switch=1) == [2]


def test_possession_candidates(spark):
    players = [("v", 0, 0, 1, 0.0, 0.0, 50.0, 200.0), ("v", 0, 1, 2, 300.0, 0.0, 350.0, 200.0), ("v", 1, 0, 1, 10.0, 0.0, 60.0, 200.0)]
    p = spark.createDataFrame(players, "video_id string, frame_index long, pos int, track_id long, x1 double, y1 double, x2 double, y2 double")
    ball = lambda rows: spark.createDataFrame(rows, "video_id string, frame_index long, bx double, by double, vx double, vy double, predicted boolean, near_rim boolean")
    got = {r.frame_index: r for r in K.possession_candidates(p, ball([("v", 0, 25.0, 100.0, 0.0, 0.0, False, False), ("v", 1, 35.0, 100.0, 10.0, 0.0, True, False)])).collect()}
    assert [c.track_id for c in got[0].candidates] == [1] and got[0].entities == 2 and abs(got[0].candidates[0].score) < 1e-9
    assert got[1].candidates[0].align == 100.0 and got[1].predicted
    for row in (("v", 0, 25.0, 100.0, 150.0, 0.0, False, False), ("v", 0, 25.0, 100.0, 0.0, 0.0, False, True), ("v", 0, 150.0, 100.0, 0.0, 0.0, False, False)):
        assert not {r.frame_index: r for r in K.possession_candidates(p, ball([row])).collect()}[0].candidates


def test_shot_counts_its_opening_frame_and_weak_sides_only_fill():
    got = play(K.shot_start, K.shot_step, [shot(rim=True)] + [shot(rim=True)] * 60)
    assert [(r["start_frame"], r["end_frame"], r["made"]) for r in got] == [(0, 39, False)]
    rows = [shot(action=True, weak_side="left"), shot(rim=True, side="right"), shot(weak_side="left")] + [shot()] * 4
    assert [(r["side"], r["made"]) for r in play(K.shot_start, K.shot_step, rows)] == [("right", False)]
    assert [r["made"] for r in play(K.shot_start, K.shot_step, [shot(release=True), shot(bib=True), shot(bib=True)])] == [True]
    assert [r["made"] for r in play(K.shot_start, K.shot_step, [shot(rim=True), shot(bib=True)] + [shot()] * 4)] == [True]


def plain_shots(rows):
    out, phase, cooldown, streak, left, away, ever, reached, first = [], 0, 0, 0, 0, 0, False, False, 0
    for f, (rim, bib, action) in enumerate(rows):
        cooldown -= cooldown > 0
        streak = streak + 1 if bib else 0
        if phase == 0 and cooldown == 0 and (rim or bib or action):
            phase, left, away, ever, reached, first = 1, 40, 0, False, False, f
        if phase == 1:
            left -= 1
            ever, reached = ever or bib, reached or rim or bib
            away = 0 if rim or bib or not reached else away + 1
            made = None
            if streak >= 2:
                made = True
            elif reached and (away >= 4 or left <= 0):
                made = ever
            elif left <= 0:
                phase = streak = 0
            if made is not None:
                out.append((first, f, made))
                phase, streak, cooldown = 0, 0, 30
    return out


def test_shots_against_a_plain_loop():
    r = random.Random(8)
    for _ in range(30):
        rows = [(r.random() < 0.06, r.random() < 0.05, r.random() < 0.04) for _ in range(400)]
        got = play(K.shot_start, K.shot_step, [shot(*x) for x in rows])
        assert [(g["start_frame"], g["end_frame"], g["made"]) for g in got] == plain_shots(rows)


def test_ball_without_a_confidence_is_sure():
    row = {"candidates": [{"x": 0.0, "y": 0.0, "confidence": 0.9}, {"x": 5.0, "y": 0.0, "confidence": None}]}
    assert play(K.ball_start, K.ball_step, [row])[0]["x"] == 5.0


def test_equal_points_stay_apart_in_interval_joins(spark):
    points = spark.createDataFrame([(1, 5), (1, 5)], "k int, at int")
    spans = spark.createDataFrame([(1, 0, 9), (1, 4, 6)], "k int, s int, e int")
    assert [r.s for r in J.interval_first(points, spans, "k", "at", "s", "e", ["s"], 4).collect()] == [0, 0]


def test_nearest_in_time_and_ties(spark):
    a = spark.createDataFrame([(1, t) for t in (0, 5, 10, 40)] + [(2, 3)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 8, "y"), (1, 12, "z")], "k int, t int, v string")
    assert {(r.k, r.t): r.v for r in J.nearest_in_time(a, b, ["k"], "t", "v").collect()} == {(1, 0): "x", (1, 5): "x", (1, 10): "y", (1, 40): "z", (2, 3): None}


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def test_greedy_suppression_by_plain_loops(spark):
    r, rows = random.Random(2), []
    for f in range(300):
        for i in range(r.randint(1, 9)):
            x, y = r.uniform(0, 60), r.uniform(0, 60)
            rows.append(("v", f, i, r.choice([None, 0.1, 0.5, 0.5, 0.9]), x, y, x + 50, y + 50))
    df = spark.createDataFrame(rows, "video_id string, frame_index long, det_idx int, confidence double, x1 double, y1 double, x2 double, y2 double")
    nms, dedup = set(), set()
    for f in range(300):
        own = [x for x in rows if x[1] == f]
        kept = []
        for x in sorted(own, key=lambda x: (x[3] is None, -(x[3] or 0), x[2])):
            if all(iou(x[4:], k[4:]) < 0.35 for k in kept):
                kept.append(x)
        nms |= {(f, x[2]) for x in kept}
        gone = set()
        for i, a in enumerate(own):
            for j in range(i + 1, len(own)):
                if i in gone:
                    break
                if j in gone or iou(a[4:], own[j][4:]) < 0.45:
                    continue
                c, d = (1.0 if z[3] is None else z[3] for z in (a, own[j]))
                gone.add(j if c >= d else i)
        dedup |= {(f, i) for i in range(len(own)) if i not in gone}
    assert {(x.frame_index, x.det_idx) for x in K.suppress_overlaps(df, 0.35).collect()} == nms
    assert {(x.frame_index, x.det_idx) for x in K.drop_duplicates(df, 0.45).collect()} == dedup


def camera():
    """Focal length 1400, at (-25, 25, 35), looking at (40, 25, 7)."""
    eye, goal = np.array([-25.0, 25, 35]), np.array([40.0, 25, 7])
    ahead = (goal - eye) / np.linalg.norm(goal - eye)
    right = np.cross(ahead, [0, 0, 1])
    right /= np.linalg.norm(right)
    turn = np.stack([right, np.cross(ahead, right), ahead])
    return np.array([[1400.0, 0, 640], [0, 1400, 360], [0, 0, 1]]) @ np.column_stack([turn, -turn @ eye])


def throw(p, noise=0.0, flip=False):
    t = np.linspace(0, 0.9, 14)
    x0, vx, y0, vy, z0, vz = p
    at = np.stack([x0 + vx * t, y0 + vy * t, z0 + vz * t - 0.5 * A.GRAVITY * t * t, np.ones(14)])
    seen = camera() @ at
    uv = (seen[:2] / seen[2]).T + np.random.default_rng(42).normal(0, noise, (14, 2)) * (noise > 0)
    return np.repeat((camera() * ([1, 1, -1, 1] if flip else 1))[None], 14, 0), uv, t


def test_arcs_are_recovered(spark):
    want = (35.0, 6.0, 25.0, 0.0, 7.0, 22.0)
    got = A.fit_arc(*throw(want))
    assert np.allclose(got[:6], want, atol=1e-4) and got[7] < 1e-6 and not got[8]
    assert np.allclose(A.fit_arc(*throw(want, noise=1.0))[:6:2], want[::2], atol=2)
    turned = A.fit_arc(*throw(want, flip=True))
    assert turned[8] and np.allclose(turned[:6], want, atol=1e-4) and turned[9] > 0
    assert A.fit_arc(*(x[:2] for x in throw(want))) is None
    cams, uv, t = throw(want)
    rows = [(k, float(s), float(u), float(v), c.ravel().tolist()) for k in (1, 2) for s, (u, v), c in zip(t, uv, cams, strict=True)] + [(3, 0.0, 1.0, 1.0, cams[0].ravel().tolist())]
    fits = A.fit_arcs(spark.createDataFrame(rows, "arc long, t double, u double, v double, camera array<double>"), ["arc"])
    out = fits.select("arc", A.arc_end(F.col("z0"), F.col("vz"), F.lit(0.9))["how"].alias("how"), A.is_physical(F.col("n"), F.col("z0"), F.col("min_z")).alias("ok")).collect()
    assert {(r.arc, r.how, r.ok) for r in out} == {(1, "rim", True), (2, "rim", True)}


def test_matching_by_plain_loops(spark):
    r, said, truths = random.Random(6), [], []
    for image in range(40):
        for i in range(r.randint(0, 6)):
            x = r.uniform(0, 40)
            said.append((image, i, r.random(), x, 0.0, x + 30, 30.0))
        for i in range(r.randint(0, 5)):
            x = r.uniform(0, 40)
            truths.append((image, i, x, 0.0, x + 30, 30.0))
    a = spark.createDataFrame(said, "image int, det_idx long, confidence double, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(truths, "image int, gt_idx long, x1 double, y1 double, x2 double, y2 double")
    want = set()
    for least in (0.5, 0.75):
        for image in range(40):
            free = [g[2:] for g in truths if g[0] == image]
            for s in sorted((s for s in said if s[0] == image), key=lambda s: -s[2]):
                best = max(free, key=lambda g: iou(s[3:], g), default=None)
                hit = best is not None and iou(s[3:], best) >= least
                if hit:
                    free.remove(best)
                want.add((image, s[1], least, hit))
    assert {(x.image, x.det_idx, x.threshold, x.hit) for x in A.matched(a, b, ["image"], [0.5, 0.75]).collect()} == want


def test_documents_of_neither_shape_are_an_error(spark, tmp_path):
    from hardwood.sources.documents import read_frames, read_roster

    (tmp_path / "a.json").write_text(json.dumps({"other": 1}))
    with pytest.raises(Exception, match="no frames in"):
        read_frames(spark, f"{tmp_path}/a.json").collect()
    (tmp_path / "r.json").write_text(json.dumps({"Celtics": {"color": "#00ff00", "players": {"0": "Tatum", "7": "Brown"}}}))
    roster = read_roster(spark, f"{tmp_path}/r.json")
    tracks = spark.createDataFrame([(1, "Celtics", "7"), (2, "Celtics", "9"), (3, None, "7"), (4, "Knicks", None)], "track_id int, team string, number string")
    assert {r.track_id: r.name for r in J.roster_names(tracks, roster).collect()} == {1: "Brown", 2: None, 3: None, 4: None}


def test_precisions_at_once_are_those_one_by_one(spark):
    """Lists of hits, put in order once, give what a row a threshold gives; the order is written once, not once a threshold."""
    thresholds = [0.5, 0.6, 0.75, 0.9]
    a = spark.range(300).selectExpr("id % 60 image", "id det_idx", "id * 37 % 101 / 101 confidence", "double(id % 5 * 30 + id * 7 % 13) x1", "0D y1", "double(id % 5 * 30 + id * 7 % 13 + 40) x2", "80D y2")
    b = spark.range(250).selectExpr("id % 58 image", "id gt_idx", "double(id % 5 * 30) x1", "0D y1", "double(id % 5 * 30 + 40) x2", "80D y2")
    lists = A.matched_lists(a, b, ["image"], thresholds).withColumns({"n": F.lit(250), "class": F.col("image") % 2})
    single = A.matched(a, b, ["image"], thresholds).withColumns({"n": F.lit(250), "class": F.col("image") % 2})
    assert lists.count() == 300 and single.count() == 1200
    order = (F.desc("confidence"), "image", "det_idx")
    want = {(r["class"], r.threshold): r.ap for r in Q.average_precision(single, ["class", "threshold"], "hit", "n", *order).collect()}
    got = {(r["class"], r.threshold): r.ap for r in Q.average_precisions(lists, ["class"], "hits", thresholds, "n", *order).collect()}
    assert got == pytest.approx(want) and len(got) == 8 and len(set(got.values())) > 4
