"""Runs, modes, locks and other operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.ranges import running_sums


def with_runs(df: DataFrame, keys: list[str], at: str, gap: int = 1, name: str = "run_id") -> DataFrame:
    """Number the runs of ``at`` within each key: a new one begins where the step exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn(name, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_seen_mode(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Most frequent non-null value of each key; of equally frequent ones the first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(at).alias("first_seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), "first_seen", value)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select(*keys, value, "votes")


def consecutive_lock(df: DataFrame, keys: list[str], value: str, at: str, n: int) -> DataFrame:
    """The first value of each key that comes ``n`` times in a row, and where it locks."""
    w = Window.partitionBy(*keys).orderBy(at)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    runs = df.where(F.col(value).isNotNull()).withColumn("island", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(at))
    locked = runs.withColumn("nth", nth).where(F.col("nth") == n)
    return locked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).where("r = 1").select(*keys, value, F.col(at).alias("locked_at"))


def changes(df: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """How often the last non-null value of each key changes."""
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("b", before).groupBy(*keys).agg(F.count(F.when(F.col(value) != F.col("b"), 1)).alias("changes"))


def quadratic_fit(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """Least-squares parabola a t² + b t + c of each key from power sums; null if singular."""
    s = {f"s{k}": F.sum(F.pow(F.col(t).cast("double"), F.lit(float(k)))) for k in range(5)}
    m = {f"m{k}": F.sum(F.pow(F.col(t).cast("double"), F.lit(float(k))) * F.col(y)) for k in range(3)}
    sums = df.groupBy(*keys).agg(*(c.alias(n) for n, c in (s | m).items()))

    def det(a, b, c) -> Column:
        e = [F.expr(x) if isinstance(x, str) else x for x in (*a, *b, *c)]
        return e[0] * (e[4] * e[8] - e[5] * e[7]) - e[1] * (e[3] * e[8] - e[5] * e[6]) + e[2] * (e[3] * e[7] - e[4] * e[6])

    rows = (("s4", "s3", "s2", "m2"), ("s3", "s2", "s1", "m1"), ("s2", "s1", "s0", "m0"))
    pick = lambda *cols: det(*(tuple(r[i] for i in cols) for r in rows))
    d = F.nullif(pick(0, 1, 2), F.lit(0.0))
    return sums.select(*keys, (pick(3, 1, 2) / d).alias("a"), (pick(0, 3, 2) / d).alias("b"), (pick(0, 1, 3) / d).alias("c"))


def precision_recall(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1; 0 where a denominator is 0."""
    n = df.agg(F.count(F.when(truth & said, 1)).alias("tp"), F.count(F.when(~truth & said, 1)).alias("fp"), F.count(F.when(truth & ~said, 1)).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def average_precision(said: DataFrame, keys: list[str], hit: str, truths: str, *order) -> DataFrame:
    """Interpolated average precision of each key's answers, surest first in ``order``.

    ``hit`` says whether an answer is right, ``truths`` (the same in all rows of a key) how many
    right ones there are. At each of 101 recalls, 0 to 1, counts the best precision at that recall
    or beyond, 0 if it is never reached. Keys without truths get null. A key's answers are spread over
    ranges, so none is held by one task.
    """
    sums = running_sums(said, keys, list(order), {"__tp": F.col(hit).cast("long"), "__k": F.lit(1).cast("long")})
    return _interpolated(sums.select(*keys, F.col(truths).alias("__n"), "__tp", "__k"), keys)


def average_precisions(said: DataFrame, keys: list[str], hits: str, thresholds: list[float], truths: str, *order) -> DataFrame:
    """keys, threshold and ap: ``average_precision`` at each of ``thresholds``, from answers whose list ``hits`` says of each
    whether it is right. Answers are put in order once for all thresholds."""
    right = {f"__tp_{i}": F.get(hits, F.lit(i)).cast("long") for i in range(len(thresholds))}
    sums = running_sums(said, keys, list(order), right | {"__k": F.lit(1).cast("long")})
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(n).alias("__tp")) for t, n in zip(thresholds, right, strict=True))))
    points = sums.select(*keys, F.col(truths).alias("__n"), "__k", each.alias("__x")).select(*keys, "__n", "__k", "__x.*")
    return _interpolated(points, [*keys, "threshold"])


def _interpolated(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ap from the right answers __tp among the __k surest, at every place, of __n truths."""
    # Of each recall one row is left, so what follows is 101 rows a key.
    step = F.floor(100 * F.col("__tp") / F.nullif(F.col("__n"), F.lit(0))).cast("int").alias("__step")
    best = points.groupBy(*keys, step).agg(F.max(F.col("__tp") / F.col("__k")).alias("__p"), F.max("__n").alias("__n"))
    grid = best.groupBy(*keys).agg(F.max("__n").alias("__all")).withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(100))))
    beyond = Window.partitionBy(*keys).orderBy("__step").rowsBetween(0, Window.unboundedFollowing)
    at = grid.join(best.drop("__n"), [*keys, "__step"], "left").withColumn("__best", F.coalesce(F.max("__p").over(beyond), F.lit(0.0)))
    return at.groupBy(*keys).agg(F.when(F.max("__all") > 0, F.avg("__best")).alias("ap"))
