"""Frame-local, as-of, nearest and interval joins with stated ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions.geometry import Box, distance, iou


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order, which must be total for a stable result."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], a: Box, b: Box, ids: tuple[str, str], least: float) -> DataFrame:
    """Per key the pair of boxes with the largest overlap, at least ``least``; ties by ``ids``."""
    pairs = left.join(right, keys).withColumn("iou", iou(a, b)).where(F.col("iou") >= least)
    return first_by(pairs, keys, F.desc("iou"), *ids)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], clamp: bool = False) -> DataFrame:
    """Each left row with ``values`` of the last right row at or before its ``time``.

    One union and one window per key: no pairs are formed. Equal times: the right row counts. Of
    right rows at one time the last in order of ``values`` counts. A left row before all right rows gets nulls, with
    ``clamp`` the values of the first right row of its key.
    """
    mark = F.struct(*(F.col(v) for v in values))
    empty = F.lit(None).cast(right.select(mark.alias("v")).schema["v"].dataType)
    lefts = left.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(time).alias("__t"), F.lit(1).alias("__side"), empty.alias("__v"), F.struct(*left.columns).alias("__row"))
    none = F.lit(None).cast(lefts.schema["__row"].dataType)
    rights = right.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(time).alias("__t"), F.lit(0).alias("__side"), mark.alias("__v"), none.alias("__row"))
    w = Window.partitionBy(*(f"__{k}" for k in keys)).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    out = lefts.union(rights).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    if clamp:
        first = right.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(F.struct(F.col(time).alias("t"), mark.alias("v")))["v"].alias("__first"))
        out = out.join(first, [f"__{k}" for k in keys], "left").withColumn("__last", F.coalesce("__last", "__first"))
    return out.select("__row.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def interval_first(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, order: list[str], bucket: int) -> DataFrame:
    """Each point with the first span (in ``order``) that holds it, inner.

    Spans are laid out over buckets of at least ``bucket`` units, so the join has an equality and never is a
    nested loop. A longer span goes by buckets of doubled length, up to its own, so each takes three rows at most; a
    point has a row for each length in use. Equal points are separate ones.
    """
    points = points.withColumn("__n", F.monotonically_increasing_id())
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)).cast("double") / bucket, F.lit(1.0))))).cast("int")
    spans = spans.where(F.col(end) >= F.col(start)).withColumn("__level", level)
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())
    place = lambda c, k: F.floor(c / (bucket * F.pow(F.lit(2.0), k)))
    laid = spans.withColumn("__b", F.explode(F.sequence(place(F.col(start), F.col("__level")), place(F.col(end), F.col("__level")))))
    points = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    pairs = points.withColumn("__b", place(F.col(at), F.col("__level"))).join(laid, [key, "__level", "__b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b", "__level")
    return first_by(pairs, ["__n"], *order).drop("__n")


def near_pairs(players: DataFrame, keys: list[str], above: float, below: float, order: str = "track_id") -> DataFrame:
    """Pairs of one frame and team, i before j in ``order``, whose distance lies strictly between two bounds.

    The frame is an equality key, so the distance stays a condition of a hash join.
    """
    i = players.select(*keys, F.col(order).alias("i_at"), F.col("track_id").alias("i"), F.col("x_ft").alias("ix"), F.col("y_ft").alias("iy"))
    j = players.select(*keys, F.col(order).alias("j_at"), F.col("track_id").alias("j"), F.col("x_ft").alias("jx"), F.col("y_ft").alias("jy"))
    gap = distance(F.col("ix"), F.col("iy"), F.col("jx"), F.col("jy"))
    return i.join(j, keys).where((F.col("i_at") < F.col("j_at")) & (gap > above) & (gap < below)).withColumn("pair_dist", gap)


def roster_names(tracks: DataFrame, roster: DataFrame) -> DataFrame:
    """Left join by team and number; null on any miss. Whether the roster is broadcast is Spark's
    choice by its size."""
    return tracks.join(roster, ["team", "number"], "left")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the right row whose ``time`` is nearest, of two as near the earlier;
    null without any. One union and two windows per key: no pairs are formed."""
    row = F.struct(*left.columns)
    mark = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    names = [F.col(k).alias(f"__{k}") for k in keys]
    lefts = left.select(*names, F.col(time).alias("__t"), row.alias("__row"))
    rights = right.select(*names, F.col(time).alias("__t"), mark.alias("__v"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(*(f"__{k}" for k in keys)).orderBy("__t").rangeBetween
    before = F.last("__v", ignorenulls=True).over(w(Window.unboundedPreceding, 0))
    after = F.first("__v", ignorenulls=True).over(w(0, Window.unboundedFollowing))
    out = both.withColumns({"__before": before, "__after": after}).where("__row is not null")
    t, b, a = F.col("__t"), F.col("__before"), F.col("__after")
    pick = F.when(b.isNull() | (a["t"] - t < t - b["t"]), a).otherwise(b)
    return out.select("__row.*", pick["v"].alias(value))


def within_linger(points: DataFrame, events: DataFrame, key: str, at: str, start: str, linger: int) -> DataFrame:
    """Pairs of points and events of one key with start <= at <= start + linger, by buckets as long as that."""
    b = F.floor(F.col(start) / linger)
    laid = events.withColumn("__b", F.explode(F.array(b, b + 1)))
    return points.withColumn("__b", F.floor(F.col(at) / linger)).join(laid, [key, "__b"]).where(F.col(at).between(F.col(start), F.col(start) + linger)).drop("__b")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pairs of points and boxes of one frame that hold them, edges included."""
    inside = F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))
    return points.join(boxes, keys).where(inside)
