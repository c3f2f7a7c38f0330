"""Screens against a plain loop over frames."""

import math
import random

import pytest

from hardwood.plans import screens as S

BASKETS = {"left": (5.25, 25.0), "right": (88.75, 25.0)}
SCHEMA = "video_id string, frame_index long, pos int, track_id long, team string, x_ft double, y_ft double"


def nearest(xys):
    c = [sum(v) / len(xys) for v in zip(*xys, strict=True)]
    return "left" if math.dist(c, BASKETS["left"]) <= math.dist(c, BASKETS["right"]) else "right"


def detect(rows, holder):
    """(screener, screenee), team and basket of one frame's (track, team, xy), or None."""
    teams = {}
    for k, team, xy in rows:
        if team is not None:
            teams.setdefault(team, []).append((k, xy))
    if len(teams) < 2:
        return None
    own = [t for t, ps in teams.items() if any(k == holder for k, _ in ps)]
    far = {t: sum(math.dist(xy, BASKETS[nearest([q for _, q in ps])]) for _, xy in ps) / len(ps) for t, ps in teams.items()}
    team = own[0] if own else max(far, key=far.get)
    off, best = teams[team], None
    for i, (a, p) in enumerate(off):
        for b, q in off[i + 1 :]:
            gap, block = math.dist(p, q), None
            if not 4 < gap < 8:
                continue
            for xy in (xy for t, ps in teams.items() if t != team for _, xy in ps):
                t = ((xy[0] - p[0]) * (q[0] - p[0]) + (xy[1] - p[1]) * (q[1] - p[1])) / gap**2
                perp = math.dist(xy, (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                if min(math.dist(xy, p), math.dist(xy, q)) < 4 and 0.15 < t < 0.85 and perp < 4 and (block is None or perp < block[0]):
                    block = perp, xy
            if block and (best is None or gap < best[0]):
                best = gap, (a, b) if math.dist(block[1], p) <= math.dist(block[1], q) else (b, a)
    return best and (best[1], team, nearest([xy for _, xy in off]))


def plain(frames, holders):
    """Screens of a video: {frame_index: [(track, team, xy)]}."""
    runs, at = {}, {f: {k: xy for k, _, xy in rows} for f, rows in frames.items()}
    for f in sorted(frames):
        found = detect(frames[f], holders.get(f))
        if found:
            own = runs.setdefault(frozenset(found[0]), [])
            if not own or f - own[-1][-1][0] > 5:
                own.append([])
            own[-1].append((f, *found))
    out = []
    for run in (r for rs in runs.values() for r in rs if len(r) >= 3):
        votes = {}
        for _, pair, _, _ in run:
            votes[pair] = votes.get(pair, 0) + 1
        er, ee = max(votes, key=votes.get)
        start, end = run[0][0], run[-1][0]
        f, _, _, side = min(run, key=lambda r: math.dist(at[r[0]][er], at[r[0]][ee]))
        first = next(at[g][er] for g in range(start - 8, start + 1) if er in at.get(g, {}))
        last = next(at[g][ee] for g in range(end + 8, end - 1, -1) if ee in at.get(g, {}))
        basket, (sx, sy) = BASKETS[side], at[f][ee]
        move, goal = (last[0] - sx, last[1] - sy), (basket[0] - sx, basket[1] - sy)
        if math.dist(basket, first) - math.dist(basket, at[f][er]) > 3:
            kind = "down"
        elif math.hypot(*move) < 1e-6:
            kind = "undefined"
        else:
            cos = (move[0] * goal[0] + move[1] * goal[1]) / math.hypot(*move) / math.hypot(*goal)
            kind = "back" if math.degrees(math.acos(max(-1, min(1, cos)))) < 60 else "front"
        out.append((start, f, end, len(run), er, ee, run[0][2], side, kind))
    return sorted(out)


def found(spark, frames, holders):
    data = [("v", f, pos, k, team, float(xy[0]), float(xy[1])) for f, rows in frames.items() for pos, (k, team, xy) in enumerate(rows)]
    who = spark.createDataFrame([("v", f, k) for f, k in holders.items()], "video_id string, frame_index long, possessor_track_id long") if holders else None
    cols = ("start_frame", "screen_frame", "end_frame", "frames", "screener", "screenee", "team", "basket", "screen_type")
    return sorted(tuple(r) for r in S.screens(spark.createDataFrame(data, SCHEMA), who).select(*cols).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_screens_match_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    place = {k: [rng.uniform(30, 45), rng.uniform(20, 30)] for k in range(10)}
    frames, holders = {}, {}
    for f in range(600):
        for p in place.values():
            for c, low, high in ((0, 28, 66), (1, 17, 33)):
                p[c] = min(high, max(low, p[c] + rng.uniform(-0.5, 0.5) + (0.06 if c == 0 and f < 400 else -0.06 if c == 0 else 0)))
        rows = [(k, None if rng.random() < 0.02 else "white" if k < 5 else "dark", tuple(p)) for k, p in place.items() if rng.random() > 0.05]
        rng.shuffle(rows)
        frames[f] = rows
        if rng.random() < 0.5:
            holders[f] = rng.randrange(12)
    want = plain(frames, holders)
    assert len(want) > 5 and len({w[-1] for w in want}) > 1 and max(w[2] - w[0] for w in want) > 16
    assert found(spark, frames, holders) == want
    assert found(spark, frames, {}) == plain(frames, {})


def test_long_run_is_seen_from_before_its_start_to_after_its_end(spark):
    """30 frames of contact: the screener came toward the basket before them, so this is a down screen."""
    frames = {f: [(1, "white", (20.0 + max(0, 8 - f), 25.0)), (2, "white", (20.0, 30.5 if f < 38 else 45.0)), (6, "dark", (20.0, 27.5 if 8 <= f < 38 else 5.0))] for f in range(46)}
    holders = dict.fromkeys(frames, 1)
    assert found(spark, frames, holders) == plain(frames, holders) == [(8, 8, 37, 30, 1, 2, "white", "left", "down")]


def test_only_the_tightest_pair_of_a_frame_counts(spark):
    frames = {f: [(1, "white", (20.0, 20.0)), (2, "white", (20.0, 25.0)), (3, "white", (20.0, 31.0)), (6, "dark", (20.0, 22.0)), (7, "dark", (20.0, 28.0))] for f in range(4)}
    holders = dict.fromkeys(frames, 1)
    assert [g[4:6] for g in found(spark, frames, holders)] == [(1, 2)]
