"""Off-ball screens from players' positions in feet.

``players`` has one row per track and frame: video_id, frame_index, track_id, team, x_ft, y_ft and,
if known, pos, the row's place in its frame, which settles ties (else track_id does). Gaps and looks
count in frame_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import BASKETS, angle_between, classify_screen, distance, nearest_basket, segment_projection
from hardwood.operators.joins import first_by, near_pairs
from hardwood.operators.sequences import with_runs

#: Feet between screener and screenee, contact, lane, and frames of gap and of length.
NEAR, FAR, CONTACT, LANE, GAP, MIN_FRAMES, LOOK = 4.0, 8.0, 4.0, 4.0, 5, 3, 8


def _placed(players: DataFrame) -> DataFrame:
    """Players with team and position; ``at`` is the place in the frame, ``team_at`` that of the team's first."""
    known = players.where("team is not null and x_ft is not null and y_ft is not null").withColumn("at", F.col("pos" if "pos" in players.columns else "track_id"))
    return known.withColumn("team_at", F.min("at").over(Window.partitionBy("video_id", "frame_index", "team")))


def _mean(rows: Column, value) -> Column:
    """Mean in the order of ``rows``, so that it doesn't depend on how rows arrive."""
    return F.aggregate(rows, F.lit(0.0), lambda total, r: total + value(r)) / F.size(rows)


def attacking_team(players: DataFrame, possessors: DataFrame | None = None) -> DataFrame:
    """video_id, frame_index, offence, basket: the possessor's team; without one, the team farther on
    average from its basket, the one nearest to its centroid (ties: left; the team first in the frame).
    Frames with fewer than two teams are left out."""
    key = ["video_id", "frame_index"]
    known = _placed(players)
    known = known.withColumn("holds", F.lit(False)) if possessors is None else known.join(possessors.select(*key, "possessor_track_id"), key, "left").withColumn("holds", F.coalesce(F.col("track_id") == F.col("possessor_track_id"), F.lit(False)))
    teams = known.groupBy(*key, "team").agg(F.min("team_at").alias("team_at"), F.max("holds").alias("holds"), F.sort_array(F.collect_list(F.struct("at", "x_ft", "y_ft"))).alias("rows"))
    rows = F.col("rows")
    sided = teams.withColumn("basket", nearest_basket(_mean(rows, lambda r: r["x_ft"]), _mean(rows, lambda r: r["y_ft"])))
    left, right = (_mean(rows, lambda r, s=s: distance(r["x_ft"], r["y_ft"], F.lit(BASKETS[s][0]), F.lit(BASKETS[s][1]))) for s in ("left", "right"))
    order = Window.partitionBy(*key)
    far = F.when(F.col("basket") == "left", left).otherwise(right)
    first = F.row_number().over(order.orderBy(F.desc("holds"), F.desc("d"), "team_at"))
    ranked = sided.withColumn("d", F.when(~F.col("holds"), far)).withColumn("teams", F.count("*").over(order)).withColumn("r", first)
    return ranked.where("teams >= 2 and r = 1").select(*key, F.col("team").alias("offence"), "basket")


def frame_hits(players: DataFrame, offence: DataFrame) -> DataFrame:
    """Per frame and attacker pair with a defender in contact and in the lane: the closest such, with
    the pair's distance."""
    key = ["video_id", "frame_index"]
    sided = _placed(players).join(offence.select(*key, "offence"), key)
    pairs = near_pairs(sided.where("team = offence"), key, NEAR, FAR, "at")
    defenders = sided.where("team != offence").select(*key, F.col("track_id").alias("d"), "team_at", "at", F.col("x_ft").alias("dx"), F.col("y_ft").alias("dy"))
    c = {n: F.col(n) for n in ("ix", "iy", "jx", "jy", "dx", "dy")}
    t, perp = segment_projection(c["ix"], c["iy"], c["jx"], c["jy"], c["dx"], c["dy"])
    di, dj = distance(c["dx"], c["dy"], c["ix"], c["iy"]), distance(c["dx"], c["dy"], c["jx"], c["jy"])
    hits = pairs.join(defenders, key).withColumns({"t": t, "perp": perp, "di": di, "dj": dj})
    hits = hits.where((F.least("di", "dj") < CONTACT) & (F.col("t") > 0.15) & (F.col("t") < 0.85) & (F.col("perp") < LANE))
    # The attacker nearer to the defender screens.
    best = first_by(hits, [*key, "i", "j"], "perp", "team_at", "at")
    near_i = F.col("di") <= F.col("dj")
    roles = F.when(near_i, F.col("i")).otherwise(F.col("j")).alias("screener"), F.when(near_i, F.col("j")).otherwise(F.col("i")).alias("screenee")
    return best.select(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "i_at", "j_at", "d", "perp", "pair_dist", *roles)


def tightest(hits: DataFrame) -> DataFrame:
    """Of each frame's pairs the one with the least distance (ties: first in the frame)."""
    return first_by(hits, ["video_id", "frame_index"], "pair_dist", "i_at", "j_at")


def screen_runs(hits: DataFrame, gap: int = GAP, min_frames: int = MIN_FRAMES) -> DataFrame:
    """Runs of each unordered pair's hits: start, end, frames, the majority screener (ties: first seen)
    and the contact, the first frame in which the pair is closest."""
    runs = with_runs(hits, ["video_id", "i", "j"], "frame_index", gap)
    key = ["video_id", "i", "j", "run_id"]
    contact = F.min_by("frame_index", F.struct("pair_dist", "frame_index"))
    whole = runs.groupBy(*key).agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count("*").alias("frames"), contact.alias("screen_frame"))
    votes = runs.groupBy(*key, "screener", "screenee").agg(F.count("*").alias("v"), F.min("frame_index").alias("f"))
    return whole.where(F.col("frames") >= min_frames).join(first_by(votes, key, F.desc("v"), "f").drop("v", "f"), key)


def stands(runs: DataFrame, players: DataFrame, look: int = LOOK) -> DataFrame:
    """``runs`` with where screener and screenee stood: init, the first position from ``look`` frames
    before the start to the start; screen, at contact; last, the last from the end to ``look`` frames after.

    A run's frames of interest are laid out, at most 2 ``look`` + 3, so the join has only equalities.
    """
    key = ["video_id", "i", "j", "run_id"]
    spot = players.where("x_ft is not null and y_ft is not null").select("video_id", "track_id", "frame_index", F.struct("x_ft", "y_ft").alias("at"))
    start, end, contact = F.col("start_frame"), F.col("end_frame"), F.col("screen_frame")
    wanted = F.array_distinct(F.concat(F.sequence(start - look, start), F.sequence(end, end + look), F.array(contact)))
    who = F.explode(F.array(*(F.struct(F.lit(n).alias("who"), F.col(n).alias("track_id")) for n in ("screener", "screenee"))))
    laid = runs.select(*key, "start_frame", "end_frame", "screen_frame", wanted.alias("wanted"), who.alias("w"))
    laid = laid.select(*key, "start_frame", "end_frame", "screen_frame", "w.who", "w.track_id", F.explode("wanted").alias("frame_index"))
    found = laid.join(spot, ["video_id", "track_id", "frame_index"])
    f, out = F.col("frame_index"), []
    for n in ("screener", "screenee"):
        own = F.col("who") == n
        out += [
            F.min_by("at", F.when(own & f.between(start - look, start), f)).alias(f"{n}_init"),
            F.min_by("at", F.when(own & (f == contact), f)).alias(f"{n}_screen"),
            F.max_by("at", F.when(own & f.between(end, end + look), f)).alias(f"{n}_last"),
        ]
    return runs.join(found.groupBy(*key).agg(*out), key)


def classify(runs: DataFrame) -> DataFrame:
    """Screen type of each run with its ``stands`` and ``basket``: down if the screener came toward
    the basket until contact, else by the screenee's cut from contact on."""
    bx = F.when(F.col("basket") == "left", BASKETS["left"][0]).otherwise(BASKETS["right"][0])
    by = F.lit(BASKETS["left"][1])
    to_basket = lambda c: distance(F.col(f"{c}.x_ft"), F.col(f"{c}.y_ft"), bx, by)
    cut = (F.col("screenee_last.x_ft") - F.col("screenee_screen.x_ft"), F.col("screenee_last.y_ft") - F.col("screenee_screen.y_ft"))
    goal = (bx - F.col("screenee_screen.x_ft"), by - F.col("screenee_screen.y_ft"))
    return runs.withColumn("screen_type", classify_screen(to_basket("screener_init") - to_basket("screener_screen"), angle_between(*cut, *goal)))


def screens(players: DataFrame, possessors: DataFrame | None = None) -> DataFrame:
    """video_id, start_frame, screen_frame, end_frame, frames, screener, screenee, team, basket (the
    attacked one at contact), screen_type and the six positions of each screen."""
    sides = attacking_team(players, possessors)
    runs = stands(screen_runs(tightest(frame_hits(players, sides))), players)
    at = lambda frame, *cols: sides.select("video_id", F.col("frame_index").alias(frame), *cols)
    runs = runs.join(at("start_frame", F.col("offence").alias("team")), ["video_id", "start_frame"]).join(at("screen_frame", "basket"), ["video_id", "screen_frame"])
    places = [f"{n}_{p}" for n in ("screener", "screenee") for p in ("init", "screen", "last")]
    return classify(runs).select("video_id", "start_frame", "screen_frame", "end_frame", "frames", "screener", "screenee", "team", "basket", "screen_type", *places)
