"""Ranks, running sums and order statistics of groups of any size, by ranges and counts of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.shared import written

#: Bins that a round of selection cuts an interval into, rows of an interval that are few enough to be sorted, rounds at most.
BINS, FEW, ROUNDS = 1024, 10_000, 40


def ranged(df: DataFrame, *order) -> DataFrame:
    """``df`` in ``order``, cut into ranges of about equal size, with the range of each row and its place within it.

    Written once, so that whatever is counted of the ranges later fits them. Equal rows of a range
    boundary fall into one range, so the order should be a total one.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    out = written(rows, "ranged")
    return out.withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1: one shuffle by ranges, then a row a range is added up."""
    rows = ranged(df, *order)
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__place") + 1).select(*df.columns, name)


def running_sums(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``sums`` (name to column) over its key's rows up to it, in ``order``.

    A key's rows are spread over ranges. Sums run within a range; what a key has in earlier ranges is added from
    a table of at most one row a range, since only the first key of a range can have begun before it.
    """
    rows = ranged(df.withColumns({f"__{n}": c for n, c in sums.items()}), *keys, *order)
    here = Window.partitionBy("__range", *keys).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__range", *keys).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    began = F.lag("__range").over(Window.partitionBy(*keys).orderBy("__range"))
    earlier = parts.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__key_{k}") for k in keys), *(F.sum(f"__{n}").over(before).alias(f"__before_{n}") for n in sums), began.alias("__began")).where("__began is not null")
    met = rows.withColumns({f"__here_{n}": F.sum(f"__{n}").over(here) for n in sums})
    met = met.alias("a").join(F.broadcast(earlier).alias("b"), (F.col("a.__range") == F.col("b.__r")) & _same(keys), "left")
    return met.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *((F.col(f"__here_{n}") + F.coalesce(F.col(f"__before_{n}"), F.lit(0))).alias(n) for n in sums))


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.__key_{k}"))
    return same


def _narrowed(rows: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """``wide`` (keys, __k, lo, hi, below, inside) with each interval cut down to that of its bins which holds the wanted place."""
    share = (F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    # Halves, so that an interval over the whole range of doubles doesn't overflow.
    share = F.when(F.col("hi") - F.col("lo") < float("inf"), share).otherwise((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
    within = rows.join(wide, keys).where(F.col("__v").between(F.col("lo"), F.col("hi")))
    bins = within.groupBy(*keys, "__k", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("inside"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # At most BINS rows a wanted place.
    up_to = F.col("below") + F.sum("inside").over(Window.partitionBy(*keys, "__k").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumn("up_to", up_to).where((F.col("up_to") > F.col("__k")) & (F.col("up_to") - F.col("inside") <= F.col("__k")))
    return bins.select(*keys, "__k", "lo", "hi", (F.col("up_to") - F.col("inside")).alias("below"), "inside")


def values_at(df: DataFrame, keys: list[str], value: str, places: Column) -> DataFrame:
    """keys, n, __k and __x: of each key's ``n`` numbers in order those at ``places``, an array made of ``n``, counted from 0.

    Nulls and NaN don't count. Groups of any size: counts of bins narrow down the interval that holds a place, round by
    round, until few rows or one value is left; then the few are sorted. No task holds a group, and nothing
    of the rows comes to the driver. Groups must have a key; null keys are groups too.
    """
    number = F.col(value).cast("double")
    rows = df.select(*(F.col(k) for k in keys), number.alias("__v")).where(number.isNotNull() & ~F.isnan(number))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    # Keys are told by a struct, so that a null one joins as well.
    rows, groups = (d.withColumn("__key", F.to_json(F.struct(*keys))) for d in (rows, groups))
    groups = written(groups, "groups")
    wanted = groups.withColumn("__k", F.explode(F.array_distinct(places))).where((F.col("__k") >= 0) & (F.col("__k") < F.col("n")))
    wanted = wanted.select("__key", F.col("__k").cast("long").alias("__k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    open_ = (F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))
    done, todo = wanted.where(~open_), written(wanted.where(open_), "intervals")
    for _ in range(ROUNDS):
        if todo.isEmpty():
            break
        narrow = written(_narrowed(rows.select("__key", "__v"), todo, ["__key"]), "intervals")
        done, todo = done.unionByName(narrow.where(~open_)), narrow.where(open_)
    done = written(done.unionByName(todo), "intervals")
    one = done.where("lo = hi").select("__key", "__k", F.col("lo").alias("__x"))
    few = done.where("lo < hi")
    # Of a group that is small as a whole every row is numbered once; of a large one the rows of its intervals.
    small = groups.where(F.col("n") <= FEW).select("__key")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__v")) - 1
    ranked = rows.join(small, "__key", "left_semi").select("__key", "__v", nth.cast("long").alias("__k"))
    picked = ranked.join(few.select("__key", "__k"), ["__key", "__k"]).select("__key", "__k", F.col("__v").alias("__x"))
    large = few.join(small, "__key", "left_anti")
    place = F.row_number().over(Window.partitionBy("__key", "__k").orderBy("__v")) - 1 + F.col("below")
    inside = rows.select("__key", "__v").join(large, "__key").where(F.col("__v").between(F.col("lo"), F.col("hi")))
    rest = inside.withColumn("__at", place).where(F.col("__at") == F.col("__k")).select("__key", "__k", F.col("__v").alias("__x"))
    return groups.select(*keys, "n", "__key").join(one.unionByName(picked).unionByName(rest), "__key").drop("__key")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and for each of ``shares`` (name to share, 0 to 1) the quantile of the key's numbers, between neighbours in
    proportion; groups without numbers are left out."""
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in shares.items()}
    places = F.array(*(f(p).cast("long") for p in at.values() for f in (F.floor, F.ceil)))
    got = values_at(df, keys, value, places)
    here = lambda p: F.max(F.when(F.col("__k") == p.cast("long"), F.col("__x")))
    out = got.groupBy(*keys, "n").agg(*(here(f(p)).alias(f"__{name}_{s}") for name, p in at.items() for f, s in ((F.floor, "a"), (F.ceil, "b"))))
    between = lambda name, p: F.col(f"__{name}_a") + (p - F.floor(p)) * (F.col(f"__{name}_b") - F.col(f"__{name}_a"))
    return out.select(*keys, "n", *(between(name, p).alias(name) for name, p in at.items()))


def upper_medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n and the median of the key's numbers, of an even number of them the greater of the middle two."""
    return values_at(df, keys, value, F.array(F.floor(F.col("n") / 2).cast("long"))).select(*keys, "n", F.col("__x").alias(name))
