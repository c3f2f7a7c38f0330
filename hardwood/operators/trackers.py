"""Trackers that feed back from frame to frame: a filtered ball, boxes followed by overlap, camera moves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from hardwood.operators.state import run_per_video

# How the state (x, y, vx, vy) moves on in a frame; the vertical speed is not carried over.
MOTION = np.array([[1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 0.0]])
# Noise of motion and of sightings, first uncertainty; gate in pixels, least confidence, frames of holdover.
MOTION_NOISE, SIGHT_NOISE, START_NOISE, GATE, SURE, HOLDOVER = 0.1, 2.0, 10.0, 120.0, 0.25, 18
# Sightings between two checks of a flight, and the mean squared error that one may have.
CHECK_EVERY, MOST_ERROR = 15, 25.0
# Median shifts in pixels that tell a camera move, from the frame before and over a window of frames.
SHIFT, LONG_SHIFT, SHIFT_WINDOW, LEAST_COMMON = 20.0, 25.0, 6, 3
# Fixed value: least overlap by which a box goes on with a track.
SAME_BOX = 0.4

CORNERS = ("x1", "y1", "x2", "y2")
SEGMENTS = "video_id string, frame_index long, moved boolean, segment int"
FILTERED = "video_id string, frame_index long, x1 double, y1 double, x2 double, y2 double, confidence double, vx double, vy double, predicted boolean"


def filter_start() -> dict:
    return {"at": None, "spread": None, "half": None, "confidence": 0.0, "missing": 0, "frame": 0, "seen": 0, "flight": np.zeros((0, 5)), "new": []}


def _off_flight(s: dict) -> bool:
    """Whether the sightings so far leave a line in x or a parabola in y.

    Only the triangle of their QR factors is kept, so that a track of any length takes a few numbers.
    """
    s["flight"], s["new"] = np.linalg.qr(np.vstack([s["flight"], np.array(s["new"])]), mode="r"), []
    rows = s["flight"]  # columns: 1, t, t * t, x, y
    line, arc = np.linalg.qr(rows[:, [0, 1, 3]], mode="r"), np.linalg.qr(rows[:, [0, 1, 2, 4]], mode="r")
    return max(line[2, 2] ** 2, arc[3, 3] ** 2) / s["seen"] > MOST_ERROR


def filter_step(s: dict, row: dict, check: bool = True) -> list[dict]:
    """One frame of ``candidates`` (corners and confidence, null as 1): the surest within the gate of the predicted
    place, else the surest, corrects the filter. Without one the last box moves on with the prediction
    for HOLDOVER frames. A lost ball, and with ``check`` a track that is no flight, starts anew."""
    s["frame"] += 1
    if s["at"] is not None:
        s["at"] = MOTION @ s["at"]
        s["spread"] = MOTION @ s["spread"] @ MOTION.T + MOTION_NOISE * np.eye(4)
    found = []
    for c in row["candidates"] if row["candidates"] is not None else []:
        sure = 1.0 if c["confidence"] is None else c["confidence"]
        if sure >= SURE:
            found.append((sure, (c["x1"] + c["x2"]) / 2, (c["y1"] + c["y2"]) / 2, c))
    near = [f for f in found if s["at"] is None or math.hypot(f[1] - s["at"][0], f[2] - s["at"][1]) <= GATE]
    best = max(near or found, key=lambda f: f[0], default=None)
    if best is None:
        s["missing"] += 1
        if s["at"] is None or s["missing"] > HOLDOVER:
            s.update(filter_start())
            return []
    else:
        seen, c = np.array(best[1:3]), best[3]
        if s["at"] is None:
            s["at"], s["spread"] = np.array([*seen, 0.0, 0.0]), START_NOISE * np.eye(4)
        else:
            gain = s["spread"][:, :2] @ np.linalg.inv(s["spread"][:2, :2] + SIGHT_NOISE * np.eye(2))
            s["at"] = s["at"] + gain @ (seen - s["at"][:2])
            s["spread"] = s["spread"] - gain @ s["spread"][:2]
        s["half"], s["confidence"], s["missing"] = ((c["x2"] - c["x1"]) / 2, (c["y2"] - c["y1"]) / 2), best[0], 0
        t = float(s["frame"])
        s["new"].append((1.0, t, t * t, s["at"][0], s["at"][1]))
        s["seen"] += 1
        if check and s["seen"] % CHECK_EVERY == 0 and _off_flight(s):
            s.update(filter_start())
            return []
        if not check:
            s["new"] = []
    (x, y, vx, vy), (w, h) = s["at"].tolist(), s["half"]
    return [{"frame_index": row["frame_index"], "x1": x - w, "y1": y - h, "x2": x + w, "y2": y + h, "confidence": s["confidence"], "vx": vx, "vy": vy, "predicted": best is None}]


def filter_ball(frames: DataFrame) -> DataFrame:
    """``filter_step`` over all frames (video_id, frame_index, candidates) of each video; frames without a ball are left out."""
    return run_per_video(frames, filter_start, filter_step, FILTERED, ["frame_index"])


def follow_start() -> dict:
    return {"tracks": {}, "next": 1}


def _overlap(a: tuple, b: tuple) -> float:
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def follow_step(s: dict, row: dict, least: float = SAME_BOX) -> list[dict]:
    """One frame of ``boxes`` in the detector's order: each goes on with the free track that it overlaps most, the
    older of equal ones, or starts one. Tracks that no box of the frame goes on with end."""
    free, kept, out = dict(s["tracks"]), {}, []
    for i, b in enumerate(row["boxes"] if row["boxes"] is not None else []):
        at = tuple(b[c] for c in CORNERS)
        over, older = max(((_overlap(at, free[t]), -t) for t in free), default=(0.0, 0))
        track = -older if over > 0 and over >= least else s["next"]
        s["next"] += track == s["next"]
        free.pop(track, None)
        kept[track] = at
        out.append({"frame_index": row["frame_index"], "det_idx": i, "track_id": track})
    s["tracks"] = kept
    return out


def follow_boxes(frames: DataFrame) -> DataFrame:
    """video_id, frame_index, det_idx and track_id of the boxes of all frames (video_id, frame_index, boxes), empty ones included."""
    return run_per_video(frames, follow_start, follow_step, "video_id string, frame_index long, det_idx int, track_id long", ["frame_index"])


def segment_start() -> dict:
    return {"last": None, "window": [], "segment": 0}


def _shift(a: dict, b: dict) -> float | None:
    """Median way of the points that two frames share; None with too few of them."""
    ways = [math.hypot(a[k][0] - b[k][0], a[k][1] - b[k][1]) for k in a.keys() & b.keys()]
    return float(np.median(ways)) if len(ways) >= LEAST_COMMON else None


def camera_moved(s: dict, points: dict) -> bool:
    """Whether the camera moved before this frame of ``points`` (index to place): by a jump from the last frame with
    points, by a drift over the window, or because too few points are left to tell."""
    if not points:
        return False
    if s["last"] is None:
        moved = False
    elif (jump := _shift(points, s["last"])) is None or jump > SHIFT:
        moved = True
    else:
        drift = _shift(points, s["window"][0]) if len(s["window"]) >= SHIFT_WINDOW else None
        moved = drift is not None and drift > LONG_SHIFT
    s["last"] = points
    s["window"] = [] if moved else [*s["window"], points][-SHIFT_WINDOW:]
    return moved


def valid_points(row: dict) -> dict:
    return {p["kp_idx"]: (p["x"], p["y"]) for p in (row["points"] if row["points"] is not None else []) if p["valid"]}


def segment_step(s: dict, row: dict) -> list[dict]:
    moved = camera_moved(s, valid_points(row))
    s["segment"] += moved
    return [{"frame_index": row["frame_index"], "moved": moved, "segment": s["segment"]}]


def camera_segments(frames: DataFrame) -> DataFrame:
    """video_id, frame_index, moved and the number of the segment, from frames with ``points`` (kp_idx, x, y, valid)."""
    return run_per_video(frames, segment_start, segment_step, SEGMENTS, ["frame_index"])
