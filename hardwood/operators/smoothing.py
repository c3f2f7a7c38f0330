"""Releases, steady keypoints and smoothed positions of players."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import distance
from hardwood.operators.state import run_grouped

# --- Releases: the ball leaves a hand and rises -----------------------------------------------

# Pixels from a hand that holds, and from one that let go, and of the rise; steps that confirm it, rows looked back, and
# rows without another.
HELD, APART, RISE, CONFIRM, LOOKBACK, COOLDOWN = 70.0, 45.0, 18.0, 3, 10, 25

RELEASES = "video_id string, frame_index long, x double, y double, confidence double"


def hand_distance(ball: Column, wrists: Column) -> Column:
    """Distance from the ball to the nearest wrist; null without either."""
    return F.array_min(F.transform(wrists, lambda w: distance(w["x"], w["y"], ball["x"], ball["y"])))


def release_candidates(frames: DataFrame, held: float = HELD, apart: float = APART, rise: float = RISE, confirm: int = CONFIRM, lookback: int = LOOKBACK) -> DataFrame:
    """Rows of ``frames`` (video_id, frame_index, wrists, ball) at which a release shows.

    In the last ``confirm`` steps, none without ball or wrist, the distance to the nearest wrist
    grew at each and ends at ``apart`` or more, and the ball rose by ``rise`` or more; within the
    last ``lookback`` rows it was in the hand (``held`` or less). ``nth`` numbers a video's rows.
    """
    w = Window.partitionBy("video_id").orderBy("frame_index")
    rows = frames.select("video_id", "frame_index", F.col("ball")["x"].cast("double").alias("x"), F.col("ball")["y"].cast("double").alias("y"), hand_distance(F.col("ball"), F.col("wrists")).alias("d"))
    grew = F.lit(True)
    for k in range(confirm):
        now, before = (F.lag("d", i).over(w) if i else F.col("d") for i in (k, k + 1))
        grew = grew & (now > before)
    up = F.lag("y", confirm).over(w) - F.col("y")
    nearest = F.min("d").over(w.rowsBetween(1 - lookback, 0))
    marked = rows.select("*", F.row_number().over(w).alias("nth"), grew.alias("grew"), up.alias("up"), nearest.alias("nearest"))
    score = F.least(F.lit(1.0), 0.5 * F.col("d") / max(apart, 1.0) + 0.25 * F.col("up") / max(rise, 1.0))
    shown = marked.where(F.col("grew") & (F.col("d") >= apart) & (F.col("up") >= rise) & (F.col("nearest") <= held))
    return shown.select("video_id", "frame_index", "x", "y", score.alias("confidence"), "nth")


def releases(frames: DataFrame, cooldown: int = COOLDOWN, **how) -> DataFrame:
    """The candidates that stand: after one, none for ``cooldown`` rows. Only candidates reach Python."""

    def step(s: dict, row: dict) -> list[dict]:
        if row["nth"] < s["free"]:
            return []
        s["free"] = row["nth"] + cooldown
        return [{c: row[c] for c in ("frame_index", "x", "y", "confidence")}]

    return run_grouped(release_candidates(frames, **how), ["video_id"], lambda: {"free": 0}, step, RELEASES, ["frame_index"])


def release_start() -> dict:
    return {"nth": 0, "free": 0, "last": []}


def release_step(s: dict, row: dict, held: float = HELD, apart: float = APART, rise: float = RISE, confirm: int = CONFIRM, lookback: int = LOOKBACK, cooldown: int = COOLDOWN) -> list[dict]:
    """One frame (wrists, ball) of ``releases``, for streams: the last ``lookback`` distances and heights are all it needs."""
    ball, wrists = row["ball"], row["wrists"] if row["wrists"] is not None else []
    s["nth"] += 1
    d = min((math.hypot(w["x"] - ball["x"], w["y"] - ball["y"]) for w in wrists), default=None) if ball is not None else None
    s["last"] = [*s["last"], (d, None if ball is None else ball["y"])][-max(lookback, confirm + 1) :]
    steps = s["last"][-confirm - 1 :]
    if len(steps) <= confirm or any(x is None for x, _ in steps) or any(b[0] <= a[0] for a, b in zip(steps, steps[1:])):
        return []
    up = steps[0][1] - ball["y"]
    nearest = min(x for x, _ in s["last"][-lookback:] if x is not None)
    if d < apart or up < rise or nearest > held or s["nth"] < s["free"]:
        return []
    s["free"] = s["nth"] + cooldown
    return [{"frame_index": row["frame_index"], "x": float(ball["x"]), "y": float(ball["y"]), "confidence": min(1.0, 0.5 * d / max(apart, 1.0) + 0.25 * up / max(rise, 1.0))}]


# --- Keypoints: exponential smoothing of each, jumps refused ----------------------------------

KEYPOINTS = "video_id string, kp_idx int, frame_index long, x double, y double, confidence double, valid boolean"


def keypoint_start() -> dict:
    return {"x": None, "y": None, "valid": False}


def keypoint_step(s: dict, row: dict, alpha: float = 0.3, jump: float = 65.0, least: float = 0.35) -> list[dict]:
    """A sure point moves the mean, or sets it if the last was not valid; a jump or an unsure point
    leaves it and is not valid, so the next sure point sets it anew. Without an observation (null x)
    the last state holds, with confidence 0; before the first one nothing comes out."""
    x, y, conf = row["x"], row["y"], row["confidence"]
    if x is None:
        if s["x"] is None:
            return []
        conf = 0.0
    else:
        sure = conf is not None and conf > least
        far = s["valid"] and math.hypot(x - s["x"], y - s["y"]) > jump
        if s["x"] is None or (sure and not s["valid"]):
            s.update(x=x, y=y)
        elif sure and not far:
            s.update(x=alpha * x + (1 - alpha) * s["x"], y=alpha * y + (1 - alpha) * s["y"])
        s["valid"] = sure and not far
    return [{"frame_index": row["frame_index"], "x": s["x"], "y": s["y"], "confidence": conf, "valid": s["valid"]}]


def steady_keypoints(points: DataFrame) -> DataFrame:
    """video_id, kp_idx, frame_index, x, y, confidence to smoothed points. Keypoints don't depend on
    each other, so each one of a video is a group."""
    return run_grouped(points, ["video_id", "kp_idx"], keypoint_start, keypoint_step, KEYPOINTS, ["frame_index"])


# --- Positions on the court: smoothing, holdover, one dot for a renamed player ------------------

POSITIONS = "video_id string, frame_index long, pos int, track_id long, team string, x_ft double, y_ft double, missing int"


def position_start() -> dict:
    return {"tracks": {}}


def _takes_over(tracks: dict, new: int, within: float) -> int | None:
    """The nearest held-over track that a new track replaces: close by, of its team or of none known."""
    t = tracks[new]
    near = [
        (math.hypot(o["x"] - t["x"], o["y"] - t["y"]), place, k)
        for place, (k, o) in enumerate(tracks.items())
        if k != new and o["missing"] and (o["team"] is None or t["team"] is None or o["team"] == t["team"])
    ]
    best = min(near, default=None)
    return best[2] if best is not None and best[0] <= within else None


def position_step(s: dict, row: dict, alpha: float = 0.35, jump: float = 4.0, speed: float = 1.0, holdover: int = 20, merge: float = 10.0) -> list[dict]:
    """``players``: track_id, team, x_ft, y_ft of the frame, one each. All live tracks come out, oldest first."""
    tracks, seen = s["tracks"], set()
    for p in row["players"] if row["players"] is not None else []:
        k, x, y, team = (p[c] for c in ("track_id", "x_ft", "y_ft", "team"))
        seen.add(k)
        if k not in tracks:
            tracks[k] = {"x": x, "y": y, "team": team, "missing": 0}
            gone = _takes_over(tracks, k, merge) if merge > 0 else None
            if gone is not None:
                del tracks[gone]
            continue
        t = tracks[k]
        t["team"] = t["team"] if team is None else team
        if math.hypot(x - t["x"], y - t["y"]) <= jump + t["missing"] * speed:
            t.update(x=alpha * x + (1 - alpha) * t["x"], y=alpha * y + (1 - alpha) * t["y"], missing=0)
        else:
            t["missing"] += 1
            if t["missing"] > holdover:
                del tracks[k]
    for k, t in tracks.items():
        t["missing"] += k not in seen
    s["tracks"] = tracks = {k: t for k, t in tracks.items() if t["missing"] <= holdover}
    return [{"frame_index": row["frame_index"], "pos": i, "track_id": k, "team": t["team"], "x_ft": t["x"], "y_ft": t["y"], "missing": t["missing"]} for i, (k, t) in enumerate(tracks.items())]


def smooth_positions(frames: DataFrame) -> DataFrame:
    """video_id, frame_index, players to smoothed positions; a video is one group, as tracks replace each other."""
    return run_grouped(frames, ["video_id"], position_start, position_step, POSITIONS, ["frame_index"])
