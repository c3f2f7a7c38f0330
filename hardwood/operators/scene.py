"""Rims and balls of a frame, masks, identities and series: joins and aggregates with stated ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import COURT_LENGTH, distance
from hardwood.functions.labels import colour_distance
from hardwood.operators.joins import first_by
from hardwood.operators.sequences import first_seen_mode

# Least confidence of a rim; distances in rim heights of a ball at the rim and of one that makes a basket
# credible; share of a mask's width, in its middle, that a foot is looked for in.
RIM_SURE, AT_RIM, CREDIBLE, BAND = 0.30, 1.8, 2.5, 0.6


def court_side(x_ft: Column, x: Column, width: Column) -> Column:
    """left or right by the place on the court, without one by the half of the image, else null."""
    return F.when(x_ft.isNotNull(), F.when(x_ft < COURT_LENGTH / 2, "left").otherwise("right")).when(width > 0, F.when(x < width / 2, "left").otherwise("right"))


def _sure(rims: DataFrame) -> DataFrame:
    """Rims (rim_idx, rx, ry, rh: centre and height) that are sure enough; those without a confidence are."""
    return rims.where(F.col("confidence").isNull() | (F.col("confidence") >= RIM_SURE)).drop("confidence")


def balls_at_rims(balls: DataFrame, rims: DataFrame, keys: list[str]) -> DataFrame:
    """``balls`` (keys, bx, by) with at_rim and the rim (rx, ry) that is nearest in heights of its own, the first of equal ones."""
    near = distance(F.col("bx"), F.col("by"), F.col("rx"), F.col("ry")) / F.greatest("rh", F.lit(1.0))
    best = first_by(balls.join(_sure(rims), keys, "left").withColumn("gap", near), keys, F.asc_nulls_last("gap"), "rim_idx")
    at = F.coalesce(F.col("gap") <= AT_RIM, F.lit(False))
    return best.select(*balls.columns, at.alias("at_rim"), F.when(at, F.col("rx")).alias("rx"), F.when(at, F.col("ry")).alias("ry"))


def credible_baskets(baskets: DataFrame, balls: DataFrame, rims: DataFrame, keys: list[str]) -> DataFrame:
    """``baskets`` (keys, cx, cy), one a key, with credible: a ball within CREDIBLE heights of the nearest rim; without a rim
    always, without a ball never."""
    near = distance(F.col("cx"), F.col("cy"), F.col("rx"), F.col("ry"))
    best = first_by(baskets.join(_sure(rims), keys, "left").withColumn("gap", near), keys, F.asc_nulls_last("gap"), "rim_idx")
    gap = distance(F.col("bx"), F.col("by"), F.col("rx"), F.col("ry")) / F.greatest("rh", F.lit(1.0))
    near_ball = best.join(balls.select(*keys, "bx", "by"), keys, "left").groupBy(*baskets.columns).agg(F.count("rx").alias("rims"), F.min(gap).alias("gap"))
    return near_ball.withColumn("credible", (F.col("rims") == 0) | F.coalesce(F.col("gap") <= CREDIBLE, F.lit(False))).drop("rims", "gap")


def mask_feet(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Box and foot of each mask from its pixels (keys, x, y): the lower medians of the columns in the middle BAND and
    of their lowest pixels; of all columns where the middle has none."""
    columns = pixels.groupBy(*keys, "x").agg(F.min("y").alias("top"), F.max("y").alias("low"))
    whole = Window.partitionBy(*keys)
    side = ((F.max("x").over(whole) - F.min("x").over(whole)) * (1.0 - BAND) / 2.0).cast("int")
    inner = F.col("x").between(F.min("x").over(whole) + side, F.max("x").over(whole) - side)
    columns = columns.withColumn("inner", inner).withColumn("any", F.max("inner").over(whole)).withColumn("use", F.col("inner") | ~F.col("any"))
    lower = lambda c: F.expr(f"percentile_disc(0.5) within group (order by case when use then {c} end)")
    return columns.groupBy(*keys).agg(F.min("x").alias("x1"), F.min("top").alias("y1"), F.max("x").alias("x2"), F.max("low").alias("y2"), lower("x").alias("foot_x"), lower("low").alias("foot_y"))


def step_quality(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Of a ball's frames (frame_index, x, y or null, raw: seen): frames, output_frames, coverage, holdover_frames, mean and
    greatest step between neighbouring frames, and mean change from one step to the next, over gaps too."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    step = distance(F.col("x"), F.col("y"), F.lag("x").over(w), F.lag("y").over(w))
    rows = frames.withColumn("step", step)
    before = F.last("step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("jerk", F.abs(F.col("step") - before))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy(*keys).agg(F.count("*").alias("frames"), F.count("x").alias("output_frames"), F.count_if(F.col("x").isNotNull() & ~F.col("raw")).alias("holdover_frames"), zero(F.avg("step")).alias("mean_step"), zero(F.max("step")).alias("max_step"), zero(F.avg("jerk")).alias("mean_jerk"))
    return out.withColumn("coverage", F.round(100.0 * F.col("output_frames") / F.col("frames"), 1))


def swapped_by_numbers(overlap: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys and swapped, from counts of numbers seen (team, side, overlap): whether team ``b`` is the white one; equal counts
    leave the order."""
    on = lambda team, side: F.coalesce(F.sum(F.when((F.col("team") == team) & (F.col("side") == side), F.col("overlap"))), F.lit(0))
    return overlap.groupBy(*keys).agg((on(a, "dark") + on(b, "white") > on(a, "white") + on(b, "dark")).alias("swapped"))


def swapped_by_colour(a: Column, b: Column, white: Column, dark: Column) -> Column:
    """Whether the roster's colours ``a`` and ``b`` fit the seen ones better the other way round; null if one is no colour."""
    return colour_distance(b, white) + colour_distance(a, dark) < colour_distance(a, white) + colour_distance(b, dark)


def filled_back(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """``df`` with the most frequent ``value`` of each key on all its rows, from the first on; its own where there is none."""
    mode = first_seen_mode(df, keys, value, at).select(*keys, F.col(value).alias("__mode"))
    return df.join(mode, keys, "left").withColumn(value, F.coalesce("__mode", value)).drop("__mode")


def most_recent(df: DataFrame, keys: list[str], item: str, at: str, most: int = 20) -> DataFrame:
    """Of each key the ``most`` items used last, each once, with their place from 1."""
    last = df.groupBy(*keys, item).agg(F.max(at).alias(at))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), item))
    return last.withColumn("place", place).where(F.col("place") <= most)


def padded_lists(df: DataFrame, keys: list[str], lists: str, fill) -> DataFrame:
    """``df`` with ``lists`` as long as the longest of its key's."""
    longest = F.max(F.size(lists)).over(Window.partitionBy(*keys))
    return df.withColumn(lists, F.concat(lists, F.array_repeat(F.lit(fill), (longest - F.size(lists)).cast("int"))))


def bounded_progress(scope: DataFrame, done: DataFrame, going: DataFrame) -> DataFrame:
    """day, scope, done and going at the end of each day that any of them (day, n) names; what goes on is at most what is
    left. One row a day, so the running sums hold days, not rows."""
    kinds = (("scope", scope), ("done", done), ("going", going))
    rows = [df.groupBy("day").agg(F.sum("n").alias(name)) for name, df in kinds]
    days = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    days = days.groupBy("day").agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n, _ in kinds))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(n).over(w) for n in ("scope", "done")}
    out = days.withColumns(sums)
    return out.withColumn("going", F.least("going", F.greatest(F.col("scope") - F.col("done"), F.lit(0))))


def padded_bounds(df: DataFrame, keys: list[str], x: str, y: str, pad: float) -> DataFrame:
    """keys, mean place and bounds widened by ``pad``."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.min(x) - pad).alias("x1"), (F.max(x) + pad).alias("x2"), (F.min(y) - pad).alias("y1"), (F.max(y) + pad).alias("y2"))


def shown(df: DataFrame, white: bool, dark: bool, possessor_only: bool) -> DataFrame:
    """Players that a viewer shows: of the teams that are on, those of no team if either is, or the possessor alone."""
    team = F.when(F.col("team") == "white", white).when(F.col("team") == "dark", dark).otherwise(white or dark)
    return df.where(team & (~F.lit(possessor_only) | (F.col("track_id") == F.col("possessor_track_id"))))


def shown_marks(marks: DataFrame, ball: bool, referees: bool, rims: bool, possessor_only: bool) -> DataFrame:
    """Boxes other than players' (kind: ball, referee, rim) that a viewer shows: those of the layers that are on, none beside the
    possessor alone. Other kinds are never shown."""
    on = [k for k, v in (("ball", ball), ("referee", referees), ("rim", rims)) if v and not possessor_only]
    return marks.where(F.col("kind").isin(on)) if on else marks.where("false")
