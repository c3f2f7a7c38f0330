"""Order-dependent operators: one step function each, run per video in batch or as a stream."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import box, centre, distance, edge_distance
from hardwood.shared import spread


def run_grouped(df: DataFrame, keys: list[str], start: Callable[[], dict], step: Callable[[dict, dict], list[dict]], schema: str, order: list[str]) -> DataFrame:
    """Apply ``step(state, row)`` to the rows of each group in order. State feeds back from row to
    row, so a group can't be split; groups run in parallel. Spark sorts, and rows stream through in
    batches with only the state kept, so memory doesn't grow with a group."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = start(), None
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != at:
                    state, at = start(), key
                out += [{k: row[k] for k in keys} | r for r in step(state, row)]
            yield pd.DataFrame(out, columns=names)

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def run_per_video(df: DataFrame, start: Callable[[], dict], step: Callable[[dict, dict], list[dict]], schema: str, order: list[str]) -> DataFrame:
    """``run_grouped`` with a video as the group."""
    return run_grouped(df, ["video_id"], start, step, schema, order)


# --- Ball: exponential smoothing with gating and holdover -------------------------------------

BALL = "video_id string, frame_index long, x double, y double, vx double, vy double, predicted boolean"


# Weight of a new place, reach of the gate and greatest jump in pixels, least confidence, frames of holdover.
ALPHA, GATE, JUMP, SURE, HOLDOVER = 0.55, 120.0, 180.0, 0.25, 18


def ball_start() -> dict:
    return {"x": None, "y": None, "vx": 0.0, "vy": 0.0, "missing": 0, "picked": None}


def ball_step(s: dict, row: dict, alpha: float = ALPHA, gate: float = GATE, jump: float = JUMP, least: float = SURE, holdover: int = HOLDOVER) -> list[dict]:
    """``candidates``: (x, y, confidence) of the frame. Picks the surest within the gate, else the surest."""
    found = [c for c in (row["candidates"] if row["candidates"] is not None else []) if c["confidence"] is None or c["confidence"] >= least]
    sure = lambda c: 1.0 if c["confidence"] is None else c["confidence"]
    near = [c for c in found if s["x"] is not None and math.hypot(c["x"] - s["x"], c["y"] - s["y"]) <= gate]
    best = max(near or found, key=sure, default=None)
    if best is not None and (s["x"] is None or math.hypot(best["x"] - s["x"], best["y"] - s["y"]) <= jump):
        x, y = best["x"], best["y"]
        if s["x"] is not None:
            x, y = alpha * x + (1 - alpha) * s["x"], alpha * y + (1 - alpha) * s["y"]
            s["vx"], s["vy"] = x - s["x"], y - s["y"]
        s.update(x=x, y=y, missing=0, picked=best)
        return [{"frame_index": row["frame_index"], "x": x, "y": y, "vx": s["vx"], "vy": s["vy"], "predicted": False}]
    if s["x"] is None:
        return []
    s["missing"] += 1
    if s["missing"] > holdover:
        if best is not None:
            s.update(ball_start())
        return []
    return [{"frame_index": row["frame_index"], "x": s["x"], "y": s["y"], "vx": s["vx"], "vy": s["vy"], "predicted": True}]


BALL_BOXES = "video_id string, frame_index long, x1 double, y1 double, x2 double, y2 double, confidence double, vx double, vy double, predicted boolean"


def ball_box_step(s: dict, row: dict, **how) -> list[dict]:
    """``ball_step`` on boxes (x1 to y2, confidence): the smoothed centre with the size and confidence of the box last picked."""
    boxes = row["candidates"] if row["candidates"] is not None else []
    centres = [{"x": (b["x1"] + b["x2"]) / 2, "y": (b["y1"] + b["y2"]) / 2, "confidence": b["confidence"], "w": (b["x2"] - b["x1"]) / 2, "h": (b["y2"] - b["y1"]) / 2} for b in boxes]
    out = []
    for r in ball_step(s, {"frame_index": row["frame_index"], "candidates": centres}, **how):
        x, y, b = r.pop("x"), r.pop("y"), s["picked"]
        corners = {"x1": x - b["w"], "y1": y - b["h"], "x2": x + b["w"], "y2": y + b["h"]}
        out.append(r | corners | {"confidence": 1.0 if b["confidence"] is None else b["confidence"]})
    return out


def track_ball_boxes(df: DataFrame) -> DataFrame:
    """video_id, frame_index, candidates (x1 to y2, confidence) to smoothed boxes."""
    return run_per_video(df, ball_start, ball_box_step, BALL_BOXES, ["frame_index"])


def surest_ball(df: DataFrame, least: float = SURE) -> DataFrame:
    """The simple mode: each frame's surest box (of equally sure ones the first; without a confidence 1), if sure enough, with the way of its
    centre since the frame before, 0 if that had none. Columns only; a video is sorted by Spark."""
    sure = lambda c: F.coalesce(c["confidence"].cast("double"), F.lit(1.0))
    ranked = F.transform("candidates", lambda c, i: F.struct(sure(c).alias("confidence"), (-i).alias("o"), c.alias("b")))
    best = F.array_max(F.transform(F.filter(ranked, lambda r: r["confidence"] >= least), lambda r: F.struct(r["confidence"], r["o"], *(r["b"][c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))))
    rows = df.select("video_id", "frame_index", best.alias("b"))
    w = Window.partitionBy("video_id").orderBy("frame_index")
    mid = lambda b, a, c: (b[a] + b[c]) / 2
    way = lambda a, c: F.coalesce(mid(F.col("b"), a, c) - mid(F.lag("b").over(w), a, c), F.lit(0.0))
    out = rows.withColumns({"vx": way("x1", "x2"), "vy": way("y1", "y2")}).where("b is not null")
    return out.select("video_id", "frame_index", *(F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")), "vx", "vy", F.lit(False).alias("predicted"))


# --- Possession: hysteresis over the nearest player -------------------------------------------

POSSESSION = "video_id string, frame_index long, possessor_track_id long"


# Frames to switch and to come loose, tie band and reach in box heights, speed of flight in heights a frame.
SWITCH, LOOSE, TIE, REACH, FLIGHT = 3, 5, 0.05, 0.35, 0.5


def possession_candidates(players: DataFrame, ball: DataFrame) -> DataFrame:
    """video_id, frame_index, entities, candidates, predicted: per frame of ``players`` (video_id,
    frame_index, pos, track_id, box) those near the ball of ``ball`` (bx, by, vx, vy, predicted, near_rim).

    A candidate has its score (distance from the widened box in heights, and a thousandth of that from
    its centre) and how well it moves with the ball, if it was there the frame before. A ball near the
    rim has no candidates, and a player no ball that flies, for one of its height. All are columns of
    one join by frame; only the short list of a frame reaches the state machine.
    """
    key = ["video_id", "frame_index"]
    b = box()
    cx, cy = centre(b)
    height = F.greatest(b[3] - b[1], F.lit(1.0))
    w = Window.partitionBy("video_id", "track_id").orderBy("frame_index")
    here = players.select(*key, "pos", "track_id", *b, cx.alias("cx"), cy.alias("cy"), height.alias("h"))
    follows = F.lag("frame_index").over(w) == F.col("frame_index") - 1
    here = here.withColumns({"mx": F.when(follows, F.col("cx") - F.lag("cx").over(w)), "my": F.when(follows, F.col("cy") - F.lag("cy").over(w))})
    met = here.join(ball.select(*key, "bx", "by", "vx", "vy", "predicted", "near_rim"), key, "left")
    edge = edge_distance(b, F.col("bx"), F.col("by"))
    speed = F.coalesce(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), F.lit(0.0))
    score = edge + 1e-3 * distance(F.col("bx"), F.col("by"), F.col("cx"), F.col("cy")) / F.col("h")
    align = F.when(speed > 1e-3, F.col("mx") * F.col("vx") + F.col("my") * F.col("vy"))
    can = (edge <= REACH) & (speed / F.col("h") <= FLIGHT) & ~F.coalesce("near_rim", F.lit(False))
    one = F.when(can, F.struct(score.alias("score"), "pos", "track_id", align.alias("align")))
    return met.groupBy(*key).agg(F.count("*").alias("entities"), F.sort_array(F.collect_list(one)).alias("candidates"), F.coalesce(F.max("predicted"), F.lit(False)).alias("predicted"))


def possession_start() -> dict:
    return {"current": None, "last": None, "pending": None, "streak": 0, "loose": 0}


def _choose(s: dict, near: list[dict], tie: float) -> int:
    """Of the candidates within ``tie`` of the best: the holder, the last one, the one that moves with the ball, the nearest."""
    close = [c for c in near if c["score"] - near[0]["score"] <= tie]
    for held in (s["current"], s["last"]):
        if held is not None and any(c["track_id"] == held for c in close):
            return held
    moving = [c for c in close if c.get("align") is not None]
    return max(moving, key=lambda c: c["align"])["track_id"] if moving and len(close) > 1 else close[0]["track_id"]


def possession_step(s: dict, row: dict, switch: int = SWITCH, loose: int = LOOSE, tie: float = TIE) -> list[dict]:
    """``candidates``: track_id and score (or edge) of the players near the ball, maybe align; ``possessor``:
    of the detector, if any; ``predicted``: no ball was seen, so the holder may stay but no one else comes."""
    near = sorted(({"score": c["score"] if "score" in c else c["edge"], "track_id": c["track_id"], "align": c.get("align")} for c in (row["candidates"] if row["candidates"] is not None else [])), key=lambda c: c["score"])
    pick = row.get("possessor")
    if pick is None and near:
        if row.get("predicted"):
            pick = s["current"] if any(c["track_id"] == s["current"] for c in near) else None
        else:
            pick = _choose(s, near, tie)
    if pick is None:
        s.update(pending=None, streak=0, loose=s["loose"] + 1)
        if s["loose"] >= loose and s["current"] is not None:
            s.update(last=s["current"], current=None)
    elif pick == s["current"]:
        s.update(pending=None, streak=0, loose=0)
    else:
        s.update(streak=s["streak"] + 1 if s["pending"] == pick else 1, pending=pick, loose=0)
        if s["streak"] >= switch or (s["current"] is None and pick == s["last"]):
            s.update(last=pick, current=pick, pending=None, streak=0)
    return [{"frame_index": row["frame_index"], "possessor_track_id": s["current"]}]


# --- Shots: idle, pending, result -------------------------------------------------------------

SHOTS = "video_id string, start_frame long, end_frame long, team string, side string, made boolean"


# Frames in the basket that make a shot, frames away that end it, its longest time and the pause after it.
BIB_FRAMES, AWAY_FRAMES, RESOLVE_FRAMES, COOLDOWN = 2, 4, 40, 30


def shot_start() -> dict:
    return {"pending": None, "cooldown": 0, "team": None, "streak": 0}


def shot_step(s: dict, row: dict, bib_needed: int = BIB_FRAMES, away_needed: int = AWAY_FRAMES, timer: int = RESOLVE_FRAMES, cooldown: int = COOLDOWN) -> list[dict]:
    """``at_rim``, ``in_basket``, ``action``, ``release``: what the frame shows; ``team``: the possessor's;
    ``side`` is the rim's or basket's and always counts, ``weak_side`` the action's and only fills."""
    if row.get("team") is not None:
        s["team"] = row["team"]
    s["cooldown"] = max(0, s["cooldown"] - 1)
    there = bool(row["at_rim"] or row["in_basket"])
    s["streak"] = s["streak"] + 1 if row["in_basket"] else 0
    p, f = s["pending"], row["frame_index"]
    if p is None:
        if s["cooldown"] or not (there or row["action"] or row.get("release")):
            return []
        p = s["pending"] = {"start": f, "team": s["team"], "side": None, "ever": False, "away": 0, "reached": False, "left": timer}
    p["left"] -= 1
    p["ever"] |= bool(row["in_basket"])
    p["reached"] |= there
    if row.get("side") is not None:
        p["side"] = row["side"]
    elif p["side"] is None:
        p["side"] = row.get("weak_side")
    p["away"] = p["away"] + 1 if p["reached"] and not there else 0
    late = p["left"] <= 0
    if s["streak"] >= bib_needed:
        made = True
    elif p["reached"] and (p["away"] >= away_needed or late):
        made = p["ever"]
    elif late:
        s.update(pending=None, streak=0)
        return []
    else:
        return []
    s.update(pending=None, streak=0, cooldown=cooldown)
    return [{"start_frame": p["start"], "end_frame": f, "team": p["team"], "side": p["side"], "made": made}]


def track_ball(df: DataFrame) -> DataFrame:
    """video_id, frame_index, candidates to smoothed positions."""
    return run_per_video(df, ball_start, ball_step, BALL, ["frame_index"])


def possession(df: DataFrame) -> DataFrame:
    return run_per_video(df, possession_start, possession_step, POSSESSION, ["frame_index"])


def shots(df: DataFrame) -> DataFrame:
    return run_per_video(df, shot_start, shot_step, SHOTS, ["frame_index"])


# Fixed value: rows for which a shot's result is shown, its own first.
SHOWN = 25


def shown_results(frames: DataFrame, results: DataFrame, rows: int = SHOWN) -> DataFrame:
    """video_id, frame_index, made and side of each frame of ``frames``: of the last shot (``results``: video_id, end_frame, made, side) that
    ended at most ``rows`` - 1 frames of the list before, else null. Frames count by their place in the video, so gaps don't."""
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index"))
    placed = frames.select("video_id", "frame_index").withColumn("__n", nth)
    ends = results.select("video_id", F.col("end_frame").alias("frame_index"), "made", "side").join(placed, ["video_id", "frame_index"])
    marks = placed.join(ends.select("video_id", "frame_index", F.struct(F.col("__n").alias("n"), "made", "side").alias("__mark")), ["video_id", "frame_index"], "left")
    last = F.last("__mark", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.col("__n") - last["n"] < rows
    return marks.select("video_id", "frame_index", F.when(fresh, last["made"]).alias("made"), F.when(fresh, last["side"]).alias("side"))


# --- Greedy operators within one frame --------------------------------------------------------


def per_frame(df: DataFrame, keys: list[str], order: list, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """The rows of each frame that ``choose`` names by their places in ``order``. Spark sorts, and frames
    stream through in batches; only one that a batch cuts is carried on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cut = begins(pdf)[-1]
            rest = pdf.iloc[cut:].reset_index(drop=True)
            yield from kept(pdf.iloc[:cut])
        if rest is not None:
            yield from kept(rest)

    def begins(pdf: pd.DataFrame) -> np.ndarray:
        """Where a frame begins; rows without a key are frames of their own kind."""
        own, before = pdf[keys], pdf[keys].shift()
        same = ((own == before) | (own.isna() & before.isna())).all(axis=1).to_numpy(bool).copy()
        same[:1] = False
        return np.flatnonzero(~same)

    def kept(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(pdf):
            cuts = [*begins(pdf), len(pdf)]
            yield pdf.iloc[[a + i for a, b in zip(cuts, cuts[1:]) for i in sorted(choose(pdf.iloc[a:b].reset_index(drop=True)))]]

    return spread(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, df.schema)


def _overlaps(rows: pd.DataFrame) -> np.ndarray:
    """Intersection over union of all pairs of a frame's boxes."""
    x1, y1, x2, y2 = rows[["x1", "y1", "x2", "y2"]].to_numpy(float).T
    w = np.minimum(x2[:, None], x2) - np.maximum(x1[:, None], x1)
    h = np.minimum(y2[:, None], y2) - np.maximum(y1[:, None], y1)
    inter = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = (x2 - x1) * (y2 - y1)
    union = area[:, None] + area - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def suppress_overlaps(df: DataFrame, most: float) -> DataFrame:
    """Greedy suppression per frame: the surest box stays, boxes that overlap it by ``most`` or more go."""

    def choose(rows: pd.DataFrame) -> list[int]:
        over, out = _overlaps(rows) >= most, []
        for i in range(len(rows)):
            if not over[i, out].any():
                out.append(i)
        return out

    return per_frame(df, ["video_id", "frame_index"], [F.desc_nulls_last("confidence"), "det_idx"], choose)


def drop_duplicates(df: DataFrame, most: float = 0.45) -> DataFrame:
    """Per frame, of two boxes that overlap by ``most`` or more the less sure one goes, of equally sure ones the
    later. Boxes are taken in the detector's order, and one that is gone takes no other with it. Without
    a confidence a box counts as sure."""

    def choose(rows: pd.DataFrame) -> list[int]:
        over, sure = _overlaps(rows) >= most, rows["confidence"].fillna(1.0).to_numpy()
        gone: set[int] = set()
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if i in gone:
                    break
                if over[i, j] and j not in gone:
                    gone.add(j if sure[i] >= sure[j] else i)
        return [i for i in range(len(rows)) if i not in gone]

    return per_frame(df, ["video_id", "frame_index"], ["det_idx"], choose)
