"""Mixing sources to target weights, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.llm.common import WORD_PATTERN, join_hot, table, written

#: The sources' weights in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target, and so no document's copies, exceed this many times its size.
LIMIT = 3
SEED = "mix-1"
#: Up to this many sources, one row each, are broadcast.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source, source_size, target.

    The targets share the sum of all sizes by weight, none above ``limit`` times its source's
    size. With the sources sorted by how soon they reach that bound, the common level is the
    first at which none of those left is above it. One row per source, null last, so the windows
    without keys hold the sources, not the documents.
    """
    every = Window.partitionBy()
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight.cast("long"))
    fill = Window.orderBy((F.col("source_size").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0))
    per = per.withColumn("level", left.cast("double") / F.sum("w").over(after).cast("double"))
    fits = F.col("level") * F.col("w") <= F.col("source_size") * limit
    per = per.withColumn("common", F.min(F.when(fits, F.struct((F.col("source_size").cast("double") / F.col("w")).alias("k"), "level"))).over(every)["level"])
    target = F.least(F.col("common") * F.col("w"), (F.col("source_size") * limit).cast("double"))
    return per.select("source", "source_size", F.coalesce(target, (F.col("source_size") * limit).cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size (words), mix_source_size, mix_target and mix_copies.

    A source's repetition rate is target / size. A document is taken floor(rate) times, and once
    more if a number hashed from the seed and its doc_id (without one, its text) falls below the
    fraction; reruns agree. A null text has no words and a null source is a source of its own, the
    last. Repeated rows share their number. A source without words has rate 0. Extra columns are kept; those named
    like the four new ones are replaced. An empty table gives no rows.

    Sizes are summed per source before the shuffle, and one row per source is joined back.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    targets = source_targets(docs.select("source", size.alias("size")), weights, limit).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    rate = F.col("__target") / F.nullif(F.col("__source_size"), F.lit(0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, 13), 16, 10).cast("double") / float(16**13)
    copies = F.coalesce(F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0), F.lit(0)).cast("long")
    # Counted first: a few sources go to every task, so that no text is shuffled; of many the largest do.
    targets = written(targets.withColumn("__key", _key("__source")).drop("__source"), "mix-targets")
    rows = docs.withColumn("__key", _key("source"))
    out = rows.join(F.broadcast(targets), "__key") if targets.count() <= BROADCAST_SOURCES else join_hot(rows, targets, "__key")
    return out.withColumns(
        {"mix_size": size, "mix_source_size": F.col("__source_size"), "mix_target": F.col("__target"), "mix_copies": copies}
    ).drop("__key", "__source_size", "__target")


def _key(source: str) -> Column:
    """A source, or none, as a string that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def emit_mixture(docs: DataFrame, **how) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of ``docs``, whatever they are called.

    Nulls, repeated rows and an empty table are as in ``mix_sources``.
    """
    own = {c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "source", "text")}
    mixed = mix_sources(docs.withColumnsRenamed(own), **how)
    copies = F.expr("case when mix_copies > 0 then sequence(1L, mix_copies) else array() end")
    return mixed.withColumn("mix_copy", F.explode(copies)).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken")
    )


OP5_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as bigint) as w from s),
f as (select *, cast(source_size as double) / w as k,
    cast(sum(source_size) over () - coalesce(sum(source_size * 3) over (order by cast(source_size as double) / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as double)
    / cast(sum(w) over (order by cast(source_size as double) / w, source nulls last rows between current row and unbounded following) as double) as level from w),
c as (select first(level order by k, level) as common from f where level * w <= source_size * 3),
t as (select source, source_size, coalesce(least(common * w, cast(source_size * 3 as double)), cast(source_size * 3 as double)) as target from f left join c on true),
m as (select doc_id, size, source_size, target, target / nullif(source_size, 0) as rate,
    cast(cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null:' || md5(text))), 1, 13) as bigint) as double) / 4503599627370496.0 as draw
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
    cast(coalesce(floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end, 0) as bigint) * size as taken from m
"""
