"""Filters and summaries of detections, readings and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.joins import first_by


def of_classes(df: DataFrame, classes: list, least: float | None = None) -> DataFrame:
    """Rows of some classes, and of those that are sure enough; rows without a confidence stay."""
    sure = F.lit(True) if least is None else F.col("confidence").isNull() | (F.col("confidence") >= least)
    return df.where(F.col("class_id").isin(classes) & sure)


def every_nth(df: DataFrame, at: str, n: int, most: int | None = None) -> DataFrame:
    """Rows whose ``at`` is a multiple of ``n``; of those the ``most`` earliest, if that is given."""
    rows = df.where(F.col(at) % n == 0)
    return rows if most is None else rows.orderBy(at).limit(most)


def tracked(df: DataFrame) -> DataFrame:
    """Rows with a track; confidence 0 and class -1 where they lack one."""
    return df.where("track_id is not null").withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "class_id": F.coalesce("class_id", F.lit(-1))})


def best_box(df: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The surest row of each key that is sure enough, the first of equal ones; without confidences the first."""
    sure = F.coalesce("confidence", F.lit(2.0))
    return first_by(df.where(sure >= least), keys, F.desc(sure), "det_idx")


def rmse(error: Column) -> Column:
    """Root mean square; errors that are not finite count as rows but not as errors."""
    finite = F.when(~F.isnan(error) & (F.abs(error) < float("inf")), error * error)
    return F.sqrt(F.coalesce(F.sum(finite), F.lit(0.0)) / F.count("*"))


def first_of_each(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def stage_times(laps: DataFrame, keys: list[str], frames: str = "frames") -> DataFrame:
    """keys, stage, seconds, share in percent, ms a frame and place by first appearance, from laps (keys, stage, at, seconds) and how many
    frames each run (keys) had; runs without time or frames are left out."""
    whole = Window.partitionBy(*keys)
    per = laps.groupBy(*keys, "stage").agg(F.sum("seconds").alias("seconds"), F.min("at").alias("__first"), F.max(frames).alias("__frames"))
    per = per.withColumns({"__all": F.sum("seconds").over(whole), "place": F.row_number().over(whole.orderBy("__first", "stage"))})
    per = per.where((F.col("__all") > 0) & (F.col("__frames") > 0))
    return per.select(*keys, "stage", "seconds", (100.0 * F.col("seconds") / F.col("__all")).alias("share"), (1000.0 * F.col("seconds") / F.col("__frames")).alias("ms_a_frame"), "place")


def speed_up(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, speed_up and efficiency of runs (keys, workers, wall, memory) with the most workers against those with one, and the
    peak of memory; null where either is missing."""
    one = F.min(F.when(F.col("workers") == 1, F.col("wall")))
    many = F.max_by(F.when(F.col("workers") > 1, F.col("wall")), F.when(F.col("workers") > 1, F.struct("workers", -F.col("wall"))))
    out = runs.groupBy(*keys).agg((one / many).alias("__up"), F.max("workers").alias("__n"), F.max("memory").alias("peak"))
    return out.select(*keys, F.round("__up", 2).alias("speed_up"), F.round(F.col("__up") / F.col("__n"), 3).alias("efficiency"), "peak")


def totals(df: DataFrame, scope: str, done: str, day: Column, end: Column) -> DataFrame:
    """One row: scope, done, percent (whole), what is left and the days left until ``end``, none below 0."""
    out = df.agg(F.sum(scope).alias("scope"), F.sum(done).alias("done"), F.greatest(F.lit(0), F.datediff(end, day)).alias("days_left"))
    return out.select("scope", "done", F.rint(100.0 * F.col("done") / F.nullif(F.col("scope"), F.lit(0))).alias("percent"), (F.col("scope") - F.col("done")).alias("left"), "days_left")


def with_offsets(rows: DataFrame, offsets: DataFrame, keys: list[str], step: str) -> DataFrame:
    """``rows`` with ``at``: the step counted from the start (``offsets``: keys, start_at) of its key."""
    return rows.join(offsets, keys).withColumn("at", F.col("start_at") + F.col(step)).drop("start_at")


def accuracy(df: DataFrame, keys: list[str], truth: str, said: str) -> DataFrame:
    """n, correct, nulls and their shares of each key; a null answer equals an empty truth."""
    right = F.coalesce(F.col(said).cast("string"), F.lit("")) == F.col(truth).cast("string")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.col(said).isNull()).alias("nulls"))
    return out.withColumns({"accuracy": 100.0 * F.col("correct") / F.col("n"), "null_share": 100.0 * F.col("nulls") / F.col("n")})


def two_way_change(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Of two runs over the same frames: frames held, different holders and the change in frames in percent."""
    out = df.groupBy(*keys).agg(F.count(a).alias("held_a"), F.count(b).alias("held_b"), F.count_distinct(a).alias("holders_a"), F.count_distinct(b).alias("holders_b"))
    return out.withColumn("change", 100.0 * (F.col("held_b") - F.col("held_a")) / F.nullif(F.col("held_a"), F.lit(0)))


def jersey_overlap(seen: DataFrame, roster: DataFrame) -> DataFrame:
    """team, side and overlap: how many different numbers of each roster team were seen on each side."""
    return seen.select("side", "number").distinct().join(roster.select("team", "number").distinct(), "number").groupBy("team", "side").agg(F.count("*").alias("overlap"))


def recent(df: DataFrame, keys: list[str], at: str, value: str, n: int) -> DataFrame:
    """Each row with the last ``n`` values up to it."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - n, 0)
    return df.withColumn("history", F.collect_list(value).over(w))


def max_normalised(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    top = F.greatest(F.max(value).over(Window.partitionBy(*keys)), F.lit(1))
    return df.withColumn("share", F.col(value) / top)
