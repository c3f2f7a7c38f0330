"""Possession from detections alone: the marked player, the ball near players and rims, frames without players, and what is odd."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import box, centre, distance, edge_distance
from hardwood.operators.joins import best_overlap, first_by
from hardwood.operators.state import possession, possession_candidates

# Overlap by which a marked box is a player's, and the reach of the ball that a marked player must have, in heights;
# least confidence of such a box; reach of a rim in its heights.
MARK_IOU, MARK_REACH, MARK_SURE, NEAR_RIM = 0.45, 0.25, 0.55, 2.5
# Distance in heights beyond which a holder is odd, and near a rim.
ODD, ODD_AT_RIM = 0.35, 0.25

FRAME = ["video_id", "frame_index"]


def first_ball(balls: DataFrame) -> DataFrame:
    """video_id, frame_index, bx, by, vx, vy and predicted of each frame's first ball (det_idx; x1 to y2, and vx, vy, predicted if
    there are such columns)."""
    cx, cy = centre(box())
    kinds = {"vx": "double", "vy": "double", "predicted": "boolean"}
    more = [(F.col(c) if c in balls.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return first_by(balls, FRAME, "det_idx").select(*FRAME, cx.alias("bx"), cy.alias("by"), *more).withColumn("predicted", F.coalesce("predicted", F.lit(False)))


def with_near_rim(balls: DataFrame, rims: DataFrame, reach: float = NEAR_RIM) -> DataFrame:
    """``balls`` (bx, by) with near_rim: whether any rim of the frame is within ``reach`` of its heights, 1 pixel at least."""
    b = box("r_")
    cx, cy = centre(b)
    met = balls.join(rims.select(*FRAME, *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2"))), FRAME, "left")
    near = distance(F.col("bx"), F.col("by"), cx, cy) <= reach * F.greatest(b[3] - b[1], F.lit(1.0))
    return met.groupBy(*balls.columns).agg(F.coalesce(F.max(near), F.lit(False)).alias("near_rim"))


def marked_players(players: DataFrame, marks: DataFrame, balls: DataFrame, least: float = MARK_IOU, needs_ball: bool = True, alone: bool = True) -> DataFrame:
    """video_id, frame_index and possessor: the player (pos, track_id, x1 to y2) that overlaps best with a box marked as in possession
    (``marks``: det_idx, confidence, x1 to y2), of equal overlaps the first player, then the first mark.

    The ball (``balls``: bx, by, predicted) must be within MARK_REACH of the player, if ``needs_ball``; with ``alone`` only where it was
    seen, not predicted or missing.
    """
    corners = ("x1", "y1", "x2", "y2")
    sure = marks.where(F.col("confidence").isNull() | (F.col("confidence") >= MARK_SURE))
    a = players.select(*FRAME, "pos", "track_id", *(F.col(c).alias(f"a_{c}") for c in corners))
    b = sure.select(*FRAME, "det_idx", *(F.col(c).alias(f"b_{c}") for c in corners))
    best = best_overlap(a, b, FRAME, box("a_"), box("b_"), ("pos", "det_idx"), least)
    met = best.join(balls.select(*FRAME, "bx", "by", "predicted"), FRAME, "left")
    near = F.coalesce(edge_distance(box("a_"), F.col("bx"), F.col("by")) <= MARK_REACH, F.lit(False))
    seen = F.col("bx").isNotNull() & ~F.coalesce("predicted", F.lit(False))
    check = (seen | F.lit(not alone)) & F.lit(needs_ball)
    return met.where(~check | near).select(*FRAME, F.col("track_id").alias("possessor"))


def possession_inputs(frames: DataFrame, players: DataFrame, balls: DataFrame, marks: DataFrame, rims: DataFrame) -> DataFrame:
    """What the possession machine reads, one row for each of ``frames`` (video_id, frame_index): entities, candidates, possessor and
    predicted. ``players``: pos, track_id, x1 to y2; ``balls``: det_idx, x1 to y2, maybe vx, vy, predicted. In a frame without
    players nobody can hold the ball, whatever is marked."""
    ball = first_ball(balls)
    near = possession_candidates(players, with_near_rim(ball, rims))
    out = frames.select(*FRAME).distinct().join(near, FRAME, "left").join(marked_players(players, marks, ball), FRAME, "left")
    return out.withColumns({"entities": F.coalesce("entities", F.lit(0).cast("long")), "predicted": F.coalesce("predicted", F.lit(False))})


def possession_from_detections(frames: DataFrame, players: DataFrame, balls: DataFrame, marks: DataFrame, rims: DataFrame) -> DataFrame:
    """video_id, frame_index, possessor_track_id and entities of each frame, from boxes alone."""
    rows = possession_inputs(frames, players, balls, marks, rims)
    return possession(rows).join(rows.select(*FRAME, "entities"), FRAME)


def possession_time(held: DataFrame) -> DataFrame:
    """video_id, possessor_track_id and frames held; frames without any player don't count, though the holder stays."""
    return held.where("entities > 0 and possessor_track_id is not null").groupBy("video_id", "possessor_track_id").agg(F.count("*").alias("frames"))


def odd_possessions(held: DataFrame, players: DataFrame, balls: DataFrame, rims: DataFrame) -> DataFrame:
    """video_id, frame_index, possessor_track_id, edge and near_rim of frames whose holder is too far from the ball: beyond ODD heights,
    beyond ODD_AT_RIM near a rim. Frames without ball or the holder's box tell nothing."""
    ball = with_near_rim(first_ball(balls).select(*FRAME, "bx", "by"), rims)
    box_of = first_by(players, [*FRAME, "track_id"], "pos").select(*FRAME, F.col("track_id").alias("possessor_track_id"), "x1", "y1", "x2", "y2")
    met = held.join(box_of, [*FRAME, "possessor_track_id"]).join(ball, FRAME)
    edge = edge_distance(box(), F.col("bx"), F.col("by"))
    return met.where((edge > ODD) | (F.col("near_rim") & (edge > ODD_AT_RIM))).select(*FRAME, "possessor_track_id", F.round(edge, 3).alias("edge"), "near_rim")


def possession_quality(held: DataFrame, odd: DataFrame) -> DataFrame:
    """Per video: frames, with_possessor, coverage in percent, switches over frames without a holder, and odd frames."""
    w = Window.partitionBy("video_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = held.withColumn("__before", F.last("possessor_track_id", ignorenulls=True).over(w))
    out = rows.groupBy("video_id").agg(F.count("*").alias("frames"), F.count("possessor_track_id").alias("with_possessor"), F.count_if(F.col("possessor_track_id") != F.col("__before")).alias("switches"))
    n = odd.groupBy("video_id").agg(F.count("*").alias("odd"))
    out = out.join(n, "video_id", "left").withColumn("odd", F.coalesce("odd", F.lit(0).cast("long")))
    return out.withColumn("coverage", F.round(100.0 * F.col("with_possessor") / F.col("frames"), 1))


def possession_counts(inputs: DataFrame, held: DataFrame, marks: DataFrame) -> DataFrame:
    """The counters of one run, per video: frames, held, loose, raw_marks, sure_marks, by_mark, by_nearness, holders and switches between
    neighbouring frames. Two runs are compared by joining their rows."""
    w = Window.partitionBy("video_id").orderBy("frame_index")
    who, before = F.col("possessor_track_id"), F.lag("possessor_track_id").over(w)
    rows = held.select(*FRAME, "possessor_track_id", before.alias("__before")).join(inputs.select(*FRAME, "possessor", "candidates"), FRAME)
    near = F.col("possessor").isNull() & (F.coalesce(F.size("candidates"), F.lit(0)) > 0)
    out = rows.groupBy("video_id").agg(
        F.count("*").alias("frames"), F.count(who).alias("held"), F.count_if(who.isNull()).alias("loose"), F.count("possessor").alias("by_mark"),
        F.count_if(near).alias("by_nearness"), F.count_distinct(who).alias("holders"), F.count_if(who != F.col("__before")).alias("switches"),
    )
    seen = marks.groupBy("video_id").agg(F.count("*").alias("raw_marks"), F.count_if(F.col("confidence").isNull() | (F.col("confidence") >= MARK_SURE)).alias("sure_marks"))
    out = out.join(seen, "video_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("raw_marks", "sure_marks")})
