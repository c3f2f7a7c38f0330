"""Teams from embeddings of players' crops: iterative clustering, and which cluster wears the bright shirts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.joins import first_by
from hardwood.shared import written

#: Rounds at most, and the squared way of a centre below which it has settled.
ROUNDS, SETTLED = 30, 1e-12
#: Digits that centres are kept to, so that the order of sums in a run doesn't show.
DIGITS = 9


def squared_distance(a: Column, b: Column) -> Column:
    """Between two arrays of numbers of equal length."""
    off = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(off, F.lit(0.0), lambda s, d: s + d)



def _listed(centres: list[list[float]]) -> Column:
    return F.array(*(F.array(*map(F.lit, c)) for c in centres))


def first_centres(rows: DataFrame, k: int, id_col: str, vector: str) -> list[list[float]]:
    """Of ``rows`` the vector with the smallest id, then k - 1 times the one farthest from all chosen, of equal ones that
    with the smallest id. Fewer where there are fewer different vectors. One aggregate of one row each."""
    one = rows.agg(F.min(F.struct(id_col, F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("m")).first()["m"]
    chosen = [] if one is None else [list(one["v"])]
    while chosen and len(chosen) < k:
        gap = F.array_min(F.transform(_listed(chosen), lambda c: squared_distance(F.col(vector), c)))
        far = rows.agg(F.max(F.struct(gap.alias("gap"), (-F.col(id_col)).alias("o"), F.transform(vector, lambda x: x.cast("double")).alias("v"))).alias("m")).first()["m"]
        if not far["gap"] > 0:
            break
        chosen.append(list(far["v"]))
    return chosen


def assigned(rows: DataFrame, centres: list[list[float]], vector: str) -> DataFrame:
    """``rows`` with ``cluster``, the place of the nearest centre, the first of equally near ones: a column, no shuffle."""
    gaps = F.transform(_listed(centres), lambda c, i: F.struct(squared_distance(F.col(vector), c).alias("gap"), i.alias("i")))
    return rows.withColumn("cluster", F.array_min(gaps)["i"])


def mean_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """cluster and centre: the mean of each component, summed by component in each task before the shuffle."""
    each = rows.select("cluster", F.posexplode(vector).alias("i", "x"))
    means = each.groupBy("cluster", "i").agg(F.round(F.avg(F.col("x").cast("double")), DIGITS).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def cluster_teams(rows: DataFrame, k: int = 2, id_col: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` with ``cluster``, and the centres, by rounds of nearest centre and mean until the centres settle.

    The start is fixed by the rows, so every run clusters alike. Rows whose vector is null, empty, of another length
    than most rows', or holds a null or no number are left out. A cluster that loses all rows keeps its centre. Only centres, k
    vectors, come to the driver.
    """
    good = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    length = good.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if length is None:
        return good.withColumn("cluster", F.lit(0)), []
    good = written(good.where(F.size(vector) == length["n"]), "team-vectors")
    centres = first_centres(good, k, id_col, vector)
    for _ in range(rounds):
        means = {r["cluster"]: r["centre"] for r in mean_vectors(assigned(good, centres, vector), vector).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        way = max(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for a, b in zip(centres, moved, strict=True))
        centres = moved
        if way < SETTLED:
            break
    return assigned(good, centres, vector), centres


def brightness_of_clusters(rows: DataFrame, bright: str, channels: list[str]) -> DataFrame:
    """cluster, n, the mean of ``bright`` and of each colour channel, and team: white for the brightest cluster (of equal ones
    the first), dark for the rest; null where there is only one, which can't be told."""
    means = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(bright).alias(bright), *(F.avg(c).alias(c) for c in channels))
    top = first_by(means.withColumn("__one", F.lit(1)), ["__one"], F.desc(bright), "cluster").select("__one", F.col("cluster").alias("__top"))
    count = means.agg(F.count("*").alias("__clusters"), F.lit(1).alias("__one"))
    told = means.withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one").join(F.broadcast(count), "__one")
    team = F.when(F.col("__clusters") > 1, F.when(F.col("cluster") == F.col("__top"), "white").otherwise("dark"))
    return told.select("cluster", "n", bright, *channels, team.alias("team"))


def agreement(rows: DataFrame, truth: str) -> DataFrame:
    """cluster, n, the commonest ``truth`` of the cluster (of equally common ones the least) and its share."""
    n = rows.groupBy("cluster", truth).agg(F.count("*").alias("c"))
    # A window, not a join with the totals: from ``cluster``, an expression of the vector, Spark infers a filter for the other
    # side of such a join, where there is no vector, once the counts are written.
    n = n.withColumn("n", F.sum("c").over(Window.partitionBy("cluster")))
    return first_by(n, ["cluster"], F.desc("c"), truth).select("cluster", "n", truth, (F.col("c") / F.col("n")).alias("share"))
