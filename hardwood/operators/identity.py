"""Who a track is: numbers that lock, valid from their frame on, and teams told apart by the least total cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.joins import asof_backward
from hardwood.operators.sequences import consecutive_lock

# Fixed value: readings in a row that lock a number.
LOCK = 3


def number_intervals(readings: DataFrame, keys: list[str], n: int = LOCK) -> DataFrame:
    """keys, number, valid_from and valid_to (null: to the end): a number that ``readings`` (keys, frame_index, number or null) show ``n``
    times in a row is its track's from then on."""
    locks = consecutive_lock(readings, keys, "number", "frame_index", n)
    return locks.select(*keys, "number", F.col("locked_at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))


def closed_intervals(marks: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """keys, value, valid_from and valid_to of marks that hold until the next of their key: neighbouring equal ones are one interval,
    valid_to is the frame before the next."""
    w = Window.partitionBy(*keys).orderBy(at)
    first = marks.withColumns({"__before": F.lag(value).over(w), "__nth": F.row_number().over(w)})
    first = first.where((F.col("__nth") == 1) | ~F.col(value).eqNullSafe(F.col("__before")))
    return first.select(*keys, value, F.col(at).alias("valid_from"), (F.lead(at).over(w) - 1).alias("valid_to"))


def valid_at(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of their key's interval that holds ``at``, null without: the last that began, if it hasn't ended.
    No pairs are formed."""
    met = asof_backward(rows, intervals.select(*keys, F.col("valid_from").alias(at), "valid_from", "valid_to", value), keys, at, ["valid_from", "valid_to", value])
    held = F.col("valid_to").isNull() | (F.col(at) <= F.col("valid_to"))
    return met.withColumn(value, F.when(held, F.col(value))).drop("valid_from", "valid_to")


def assign_two(costs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, white and dark: of two teams (``costs``: keys, team, place 0 or 1, side, cost) which plays on which side at the least total
    cost; equal totals leave the given order, and so does a missing cost."""
    cost = lambda place, side: F.sum(F.when((F.col("place") == place) & (F.col("side") == side), F.col("cost")))
    team = lambda place: F.max(F.when(F.col("place") == place, F.col("team")))
    out = costs.groupBy(*keys).agg((cost(0, "white") + cost(1, "dark")).alias("direct"), (cost(1, "white") + cost(0, "dark")).alias("swapped"), team(0).alias("a"), team(1).alias("b"))
    other = F.coalesce(F.col("swapped") < F.col("direct"), F.lit(False))
    return out.select(*keys, F.when(other, F.col("b")).otherwise(F.col("a")).alias("white"), F.when(other, F.col("a")).otherwise(F.col("b")).alias("dark"))


def identified(entities: DataFrame, intervals: DataFrame, sides: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """``entities`` (keys, frame_index, side) with number, team and name: the number valid in the frame, the team of the side (``sides``:
    side, team) and the roster's (team, number, name); each null where it isn't known."""
    rows = valid_at(entities, intervals, keys, "frame_index", "number")
    return rows.join(sides, "side", "left").join(roster.select("team", "number", "name"), ["team", "number"], "left").select(*entities.columns, "number", "team", "name")


def lock_summary(intervals: DataFrame, sides_of: DataFrame, sides: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number, team and name of each track with a number, in the order of the keys. ``sides_of``: keys, side."""
    rows = intervals.select(*keys, "number").join(sides_of, keys, "left").join(sides, "side", "left").join(roster.select("team", "number", "name"), ["team", "number"], "left")
    return rows.select(*keys, "number", "team", "name").orderBy(*keys)
