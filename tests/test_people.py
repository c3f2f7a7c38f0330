"""Teams, masks, identities, possession from boxes and viewer states against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.operators import identity as I
from hardwood.operators import masks as K
from hardwood.operators import possession as P
from hardwood.operators import state as S
from hardwood.operators import teams as T
from hardwood.operators import viewer as V

RNG = np.random.default_rng(8)


# --- Teams ----------------------------------------------------------------------------------


def plain_clusters(ids, x, k):
    centres = [x[np.argmin(ids)]]
    while len(centres) < k:
        gap = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[max(range(len(x)), key=lambda i: (gap[i], -ids[i]))])
    for _ in range(T.ROUNDS):
        at = np.argmin([((x - c) ** 2).sum(1) for c in centres], axis=0)
        moved = [np.round(x[at == i].mean(0), T.DIGITS) if (at == i).any() else c for i, c in enumerate(centres)]
        way = max(((a - b) ** 2).sum() for a, b in zip(centres, moved, strict=True))
        centres = moved
        if way < T.SETTLED:
            break
    return np.argmin([((x - c) ** 2).sum(1) for c in centres], axis=0), np.array(centres)


def vectors(spark, ids, x, **more):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(5)


@pytest.mark.parametrize("k", [2, 4])
def test_clusters_by_plain_rounds(spark, k):
    x = np.concatenate([RNG.normal(c, 1.0, (60, 5)) for c in range(0, 3 * k, 3)])
    ids = RNG.permutation(len(x))
    rows, centres = T.cluster_teams(vectors(spark, ids, x), k)
    at, want = plain_clusters(ids, x, k)
    assert np.abs(np.array(centres) - want).max() < 1e-7
    assert {r.vec_id: r.cluster for r in rows.collect()} == dict(zip(ids.tolist(), at.tolist(), strict=True))
    again = T.cluster_teams(vectors(spark, ids[::-1], x[::-1]), k)[1]
    assert np.abs(np.array(again) - centres).max() < 1e-7


def test_clusters_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [5.0, 5.0]), (8, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, centres = T.cluster_teams(df, 3)
    assert {r.vec_id: r.cluster for r in got.collect()} == {1: 0, 7: 1, 8: 1} and len(centres) == 2  # no third different vector
    assert T.cluster_teams(df.limit(0), 2)[0].count() == 0


def test_the_bright_cluster_is_white(spark):
    rows = spark.createDataFrame([(0, 50.0, 1.0), (0, 60.0, 3.0), (1, 200.0, 5.0), (2, 200.0, 9.0)], "cluster int, bright double, blue double")
    got = {r.cluster: (r.n, r.bright, r.blue, r.team) for r in T.brightness_of_clusters(rows, "bright", ["blue"]).collect()}
    assert got == {0: (2, 55.0, 2.0, "dark"), 1: (1, 200.0, 5.0, "white"), 2: (1, 200.0, 9.0, "dark")}
    assert [r.team for r in T.brightness_of_clusters(rows.where("cluster = 0"), "bright", []).collect()] == [None]


def test_agreement_of_clustered_rows(spark):
    """Every cluster's commonest label, by plain counts, from the clusters of written vectors."""
    # Ten groups of vectors; the label is that of the group but in every seventh row.
    e = spark.range(2000).selectExpr("id vec_id", "transform(sequence(0, 63), i -> cast(if(i = id % 10, 5, 0) + (id * (i + 3) % 17) / 100 as float)) embedding", "cast(if(id % 7 = 0, id % 3, id % 10) as int) label")
    rows = T.cluster_teams(e.repartition(2), 10, rounds=1)[0]
    counts = {}
    for r in rows.select("cluster", "label").collect():
        counts.setdefault(r.cluster, {}).setdefault(r.label, []).append(1)
    want = {c: (sum(map(len, k.values())), min(k, key=lambda x: (-len(k[x]), x))) for c, k in counts.items()}
    got = T.agreement(rows, "label")
    assert {r.cluster: (r.n, r.label) for r in got.collect()} == want and len(want) == 10
    # Which side of a join was ready first decided whether the query failed, so there must be none.
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


# --- Masks ----------------------------------------------------------------------------------


def some_masks(n=12, w=40, h=30):
    return [RNG.random((h, w)) < p for p in np.linspace(0.02, 0.98, n)] + [np.zeros((h, w), bool), np.eye(h, w, dtype=bool)]


def mask_rows(spark, masks):
    rows = [(i, np.packbits(m.ravel()).tobytes(), m.shape[1], m.shape[0]) for i, m in enumerate(masks)] + [(99, None, 4, 4)]
    return K.runs_of_bits(spark.createDataFrame(rows, "mask int, bits binary, width int, height int"), ["mask"])


def test_runs_give_what_pixels_give(spark):
    masks = some_masks()
    runs = mask_rows(spark, masks)
    pixels = spark.createDataFrame([(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in np.argwhere(m) for _ in range(1 + x % 2)], "mask int, x int, y int")
    both = {r.mask: (sorted(map(tuple, r.runs)) if r.runs is not None else None) for r in runs.collect()}
    assert both[99] is None and {r.mask: sorted(map(tuple, r.runs)) for r in K.runs_of_pixels(pixels, ["mask"]).collect()} == {i: r for i, r in both.items() if r}
    box = (7, 5, 22, 19)
    got = {r.mask: (r.a, r.o) for r in runs.where("mask < 99").select("mask", K.mask_area(F.col("runs")).alias("a"), K.overlap_with_box(F.col("runs"), *map(F.lit, box)).alias("o")).collect()}
    assert got == {i: (int(m.sum()), int(m[5:20, 7:23].sum())) for i, m in enumerate(masks)}
    a, b = (runs.where("mask < 99").select(F.lit(1).alias("f"), F.col("mask").alias(n), "runs") for n in "ab")
    shared = {(r.a, r.b): r.shared for r in K.overlap_of_masks(a, b, ["f"], ("a", "b")).collect()}
    assert shared == {(i, j): int((m & n).sum()) for i, m in enumerate(masks) for j, n in enumerate(masks) if (m & n).any()}


def test_feet_of_runs_by_plain_columns(spark):
    masks = some_masks()
    got = {r.mask: tuple(r)[1:] for r in K.mask_feet(mask_rows(spark, masks), ["mask"]).collect()}
    want = {}
    for i, m in enumerate(masks):
        if m.any():
            ys, xs = np.nonzero(m)
            side = int((xs.max() - xs.min()) * (1.0 - 0.6) / 2.0)
            columns = sorted(set(xs.tolist()))
            use = [x for x in columns if xs.min() + side <= x <= xs.max() - side] or columns
            low = sorted(int(ys[xs == x].max()) for x in use)
            want[i] = (xs.min(), ys.min(), xs.max(), ys.max(), use[(len(use) - 1) // 2], low[(len(low) - 1) // 2])
    assert got == want


def test_too_few_bits_are_an_error(spark):
    df = spark.createDataFrame([(1, b"\x00", 4, 4)], "mask int, bits binary, width int, height int")
    with pytest.raises(Exception, match="too few"):
        K.runs_of_bits(df, ["mask"]).collect()


def test_numbers_lie_on_the_first_best_mask(spark):
    full, half = np.ones((10, 10), bool), np.zeros((10, 10), bool)
    half[:, 5:] = True
    masks = mask_rows(spark, [full, half, full, half]).where("mask < 4")
    masks = masks.select(F.floor(F.col("mask") / 2).alias("frame"), (F.col("mask") % 2).alias("pos"), (F.col("mask") + 10).alias("track_id"), "runs").union(spark.createDataFrame([(1, 2, 99, None)], f"frame long, pos int, track_id int, runs {K.RUNS}"))
    numbers = spark.createDataFrame([(0, 0, 6, 1, 8, 3), (0, 1, 1, 1, 3, 3), (0, 2, 30, 1, 40, 3), (1, 0, 6, 1, 8, 3)], "frame long, number_idx int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.frame, r.number_idx, r.track_id, r.ios) for r in K.numbers_on_masks(numbers, masks, ["frame"]).collect())
    assert got == [(0, 0, 10, 1.0), (0, 1, 10, 1.0)]  # a frame with a player that lacks a mask is left out


# --- Viewer ---------------------------------------------------------------------------------


def test_viewer_states_by_plain_search(spark):
    times = [(v, float(t)) for v in "abc" for t in RNG.integers(-5, 60, 40)]
    frames = [(v, float(t), int(t) * 10) for v in "ab" for t in range(0, 50, 3)]
    screens = [(v, float(t), f"s{t}") for v in "ac" for t in (4, 20, 20, 33)]
    shots = [("a", 10.0, 12.5, 1), ("a", 30.0, 31.0, 2), ("b", 5.0, 50.0, 3)]
    got = V.carried_at(
        spark.createDataFrame(times, "video string, t double").repartition(4), ["video"], "t",
        {
            "frame": V.Carried(spark.createDataFrame(frames, "video string, at double, idx int"), "at", ["idx"], clamp=True),
            "screen": V.Carried(spark.createDataFrame(screens, "video string, at double, kind string"), "at", ["kind"], linger=5),
            "shot": V.Carried(spark.createDataFrame(shots, "video string, at double, till double, nr int"), "at", ["nr"], until="till"),
        },
    ).collect()
    assert len(got) == len(times)
    for r in got:
        mine = [f for f in frames if f[0] == r.video]
        before = [f for f in mine if f[1] <= r.t]
        assert (r.frame and r.frame.idx) == ((before[-1] if before else mine[0])[2] if mine else None)
        last = max((s[1:] for s in screens if s[0] == r.video and s[1] <= r.t), default=None)
        assert (r.screen and r.screen.kind) == (last[1] if last and r.t <= last[0] + 5 else None)
        last = max((s[1:] for s in shots if s[0] == r.video and s[1] <= r.t), default=None)
        assert (r.shot and r.shot.nr) == (last[2] if last and r.t <= last[1] else None)


def test_names_and_selection_in_the_viewer(spark):
    seen = [(1, 0, 7, "white"), (1, 1, 8, "white"), (1, 2, 8, "dark"), (1, 3, 7, "dark"), (2, 0, None, "dark"), (3, 0, 9, None)]
    players = spark.createDataFrame(seen, "track_id int, frame_index int, number int, side string")
    roster = spark.createDataFrame([("A", 7, "Ann"), ("B", 7, "Bo"), ("A", 9, "Cy")], "team string, number int, name string")
    sides = spark.createDataFrame([("white", "A"), ("dark", "B")], "side string, team string")
    assert sorted(map(tuple, V.track_names(players, roster, sides).collect())) == [(1, 7, "white", "Ann"), (3, 9, None, None)]
    dim = lambda ids: {r.track_id: r.dimmed for r in V.selected(players.select("track_id").distinct(), spark.createDataFrame([(i,) for i in ids], "track_id int")).collect()}
    assert dim([]) == {1: False, 2: False, 3: False} and dim([2, 2, 50]) == {1: True, 2: False, 3: True}


# --- Identity -------------------------------------------------------------------------------


def test_numbers_are_valid_from_their_lock_on(spark):
    readings = [(1, f, n) for f, n in enumerate([5, 5, None, 6, 6, 6, 5, 5, 5])] + [(2, 0, 4), (2, 1, 4)]
    locks = I.number_intervals(spark.createDataFrame(readings, "track_id int, frame_index int, number int"), ["track_id"])
    assert [tuple(r) for r in locks.collect()] == [(1, 6, 5, None)]
    entities = spark.createDataFrame([(t, f, s) for t in (1, 2, 3) for f in range(9) for s in ("white" if f % 2 else "dark",)], "track_id int, frame_index int, side string")
    roster = spark.createDataFrame([("A", 6, "Ann"), ("B", 6, "Bo")], "team string, number int, name string")
    sides = spark.createDataFrame([("white", "A"), ("dark", "B")], "side string, team string")
    got = {(r.track_id, r.frame_index): (r.number, r.team, r.name) for r in I.identified(entities, locks, sides, roster, ["track_id"]).collect()}
    assert got == {(t, f): ((6 if t == 1 and f >= 5 else None), "A" if f % 2 else "B", ("Ann" if f % 2 else "Bo") if t == 1 and f >= 5 else None) for t in (1, 2, 3) for f in range(9)}
    summary = I.lock_summary(locks, entities.groupBy("track_id").agg(F.max("side").alias("side")), sides, roster, ["track_id"])
    assert [tuple(r) for r in summary.collect()] == [(1, 6, "A", "Ann")]


def test_intervals_close_where_the_next_begins(spark):
    marks = spark.createDataFrame([(1, 0, "a"), (1, 4, "a"), (1, 9, "b"), (1, 12, None), (2, 3, None)], "track_id int, at int, team string")
    spans = I.closed_intervals(marks, ["track_id"], "team", "at")
    assert sorted(map(tuple, spans.collect()), key=str) == [(1, "a", 0, 8), (1, "b", 9, 11), (1, None, 12, None), (2, None, 3, None)]
    rows = spark.createDataFrame([(1, f) for f in range(-1, 14)] + [(3, 1)], "track_id int, at int")
    got = {(r.track_id, r.at): r.team for r in I.valid_at(rows, spans, ["track_id"], "at", "team").collect()}
    assert got == {(1, f): None if f < 0 or f > 11 else "a" if f < 9 else "b" for f in range(-1, 14)} | {(3, 1): None}


def test_two_teams_at_the_least_total_cost(spark):
    rows = [(k, t, p, s, c) for k, (aw, ad, bw, bd) in enumerate([(1, 9, 9, 1), (9, 1, 1, 9), (1, 1, 1, 1), (5, 1, 0, 5)]) for t, p, s, c in (("X", 0, "white", aw), ("X", 0, "dark", ad), ("Y", 1, "white", bw), ("Y", 1, "dark", bd))]
    got = {r.k: (r.white, r.dark) for r in I.assign_two(spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "k int, team string, place int, side string, cost double"), ["k"]).collect()}
    assert got == {0: ("X", "Y"), 1: ("Y", "X"), 2: ("X", "Y"), 3: ("Y", "X")}


# --- Possession from detections -------------------------------------------------------------

BOX = "x1 double, y1 double, x2 double, y2 double"


def scene(spark, n, players, ball=None, marks=(), rims=()):
    """Frames 0 to n - 1 with the same boxes, or those that a function of the frame gives."""
    at = lambda what, f: what(f) if callable(what) else what
    rows = lambda what, extra: [("v", f, i, *extra(i, b)) for f in range(n) for i, b in enumerate(at(what, f) or ())]
    frames = spark.createDataFrame([("v", f) for f in range(n)], "video_id string, frame_index long")
    p = spark.createDataFrame(rows(players, lambda i, b: (i + 1, *map(float, b))), f"video_id string, frame_index long, pos int, track_id long, {BOX}")
    b = spark.createDataFrame(rows(ball, lambda i, b: (*map(float, b[:4]), *(b[4:] or (0.0, 0.0, False)))), f"video_id string, frame_index long, det_idx int, {BOX}, vx double, vy double, predicted boolean")
    m = spark.createDataFrame(rows(marks, lambda i, b: (0.9, *map(float, b))), f"video_id string, frame_index long, det_idx int, confidence double, {BOX}")
    r = spark.createDataFrame(rows(rims, lambda i, b: tuple(map(float, b))), f"video_id string, frame_index long, det_idx int, {BOX}")
    return frames, p, b, m, r


def held(*parts):
    return [r.possessor_track_id for r in P.possession_from_detections(*parts).orderBy("frame_index").collect()]


A, B = (0, 0, 50, 200), (300, 0, 350, 200)


def ball(x, y=100, *more):
    return [(x - 5, y - 5, x + 5, y + 5, *more)]


def test_possession_from_boxes_as_the_scenarios_say(spark):
    assert held(*scene(spark, 3, [A], ball(25))) == [None, None, 1]
    assert held(*scene(spark, 4, [A, B], ball(25), [B])) == [None, None, 1, 1]  # the mark is on 2, the ball far from there
    assert held(*scene(spark, 4, [A, B], ball(325), [B])) == [None, None, 2, 2]
    assert held(*scene(spark, 4, [A, B], None, [B])) == [None, None, 2, 2]  # without a ball the mark counts alone
    assert held(*scene(spark, 4, [A, B], ball(25, 100, 0.0, 0.0, True), [B])) == [None, None, 2, 2]
    assert held(*scene(spark, 4, [A], ball(25), (), [(10, 80, 40, 120)])) == [None] * 4  # near the rim
    assert held(*scene(spark, 4, [A], ball(25, 100, 150.0, 0.0, False))) == [None] * 4  # in flight
    assert held(*scene(spark, 4, [A], ball(25, 100, 10.0, 0.0, False))) == [None, None, 1, 1]
    assert held(*scene(spark, 6, [A, B], lambda f: ball(25) if f < 3 else ball(325, 100, 0.0, 0.0, True))) == [None, None, 1, 1, 1, 1]  # a predicted ball takes nobody


def test_frames_without_players_hold_but_do_not_count(spark):
    parts = scene(spark, 9, lambda f: [] if f in (4, 5) else [A], ball(25), [A])
    assert held(*parts) == [None, None, 1, 1, 1, 1, 1, 1, 1]
    assert [tuple(r) for r in P.possession_time(P.possession_from_detections(*parts)).collect()] == [("v", 1, 5)]
    loose = scene(spark, 9, lambda f: [A] if f < 3 else [], ball(25))
    assert held(*loose) == [None, None, 1, 1, 1, 1, 1, None, None]  # five frames without players let go


def test_whole_possession_by_plain_loop(spark):
    """Candidates, marks, rims and frames without players of random frames through the same machine, boxes by plain code."""
    n = 300
    groups = [[(x, 0, x + 50, 200) for x in sorted(RNG.uniform(0, 700, RNG.integers(1, 5)))] for _ in range(n // 12)]
    boxes = [[] if f % 29 in (3, 4) else [tuple(np.add(b, (f % 12, 0, f % 12, 0))) for b in groups[f // 12]] for f in range(n)]
    spots = [g[RNG.integers(len(g))][0] + RNG.uniform(-10, 90) for g in groups]
    balls = [ball(spots[f // 12] + RNG.uniform(0, 12), RNG.uniform(60, 215), float(RNG.choice([0, 5, 5, 150])), 0.0, bool(RNG.random() < 0.2)) if RNG.random() < 0.85 else [] for f in range(n)]
    marks = [[tuple(np.add(boxes[f][0], RNG.uniform(0, 30)))] if boxes[f] and RNG.random() < 0.4 else [] for f in range(n)]
    rims = [[(x, 80, x + 30, 120)] for x in RNG.uniform(0, 3000, n)]
    got = held(*scene(spark, n, boxes.__getitem__, balls.__getitem__, marks.__getitem__, rims.__getitem__))
    s, last, want = S.possession_start(), {}, []
    edge = lambda b, x, y: np.hypot(max(b[0] - 15 - x, 0, x - b[2] - 15), max(b[1] - 15 - y, 0, y - b[3] - 15)) / 200
    for f in range(n):
        here = dict(enumerate(boxes[f], 1))
        row = {"frame_index": f, "candidates": [], "possessor": None, "predicted": bool(balls[f] and boxes[f] and balls[f][0][6])}
        b = balls[f][0] if balls[f] else None
        x, y = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) if b else (None, None)
        if b and not any(np.hypot(x - (r[0] + r[2]) / 2, y - 100) <= 2.5 * 40 for r in rims[f]):
            for t, p in here.items():
                if edge(p, x, y) <= 0.35 and b[4] / 200 <= 0.5:
                    c = (p[0] + p[2]) / 2
                    align = (c - last[t]) * b[4] if t in last and b[4] > 1e-3 else None
                    row["candidates"].append({"score": edge(p, x, y) + 1e-3 * np.hypot(x - c, y - 100) / 200, "track_id": t, "align": align})
        if marks[f]:
            m = marks[f][0]
            over = {t: max(0, min(p[2], m[2]) - max(p[0], m[0])) * max(0, min(p[3], m[3]) - max(p[1], m[1])) for t, p in here.items()}
            over = {t: i / (10000 + (m[2] - m[0]) * (m[3] - m[1]) - i) for t, i in over.items()}
            best = max(over, key=lambda t: (over[t], -t))
            if over[best] >= 0.45 and (not b or b[6] or edge(here[best], x, y) <= 0.25):
                row["possessor"] = best
        want.append(S.possession_step(s, row)[0]["possessor_track_id"])
        last = {t: (p[0] + p[2]) / 2 for t, p in here.items()}
    assert got == want and len(set(want)) > 3


def test_odd_holders_and_counts(spark):
    frames, p, b, m, r = scene(spark, 4, [A, B], lambda f: ball(25) if f else ball(150), lambda f: [B] if f == 1 else [], lambda f: [(60, 80, 70, 120)] if f == 2 else [])
    who = spark.createDataFrame([("v", 0, 1), ("v", 1, 2), ("v", 2, 1), ("v", 3, None)], "video_id string, frame_index long, possessor_track_id long")
    odd = P.odd_possessions(who, p, b, r)
    assert sorted((x.frame_index, x.possessor_track_id, x.edge, x.near_rim) for x in odd.collect()) == [(0, 1, 0.425, False), (1, 2, 1.3, False)]
    q = P.possession_quality(who, odd).first()
    assert (q.frames, q.with_possessor, q.switches, q.odd, q.coverage) == (4, 3, 2, 2, 75.0)
    rows = P.possession_inputs(frames, p, b, m, r)
    c = P.possession_counts(rows, who, m).first()
    assert (c.frames, c.held, c.loose, c.by_mark, c.by_nearness, c.holders, c.switches, c.raw_marks, c.sure_marks) == (4, 3, 1, 0, 2, 2, 2, 1, 1)
