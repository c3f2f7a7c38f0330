"""Shared helpers: table access, the shared folder, tables written to cut lineage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.shared import new_folder, shared_dir, written

__all__ = ["new_folder", "shared_dir", "written"]

# Fixed value: a word is a run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
# Fixed value: maps A-Z to a-z and leaves every other character alone.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing doc_id inside operators, so that it sorts after all others.
NO_ID = (1 << 63) - 1
#: Bytes of rows that a task hands to Python at once, where the session keeps Spark's own bound.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Fixed value: Spark's own bound.
SPARK_BATCH = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set so that what Python and the JVM hold of texts at once is a few MB a task,
    however long they are (a longer row is a batch of its own). A bound that the user chose stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == SPARK_BATCH:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written for one computation; each can be deleted once what was made of it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, {}, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def write_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As ``write``, in buckets of ``key``, as many as the session shuffles into: joins by ``key`` leave its rows
        where they are and shuffle the other side alone. The buckets' names are kept in the catalog until it is dropped."""
        path, called = new_folder(self.spark, name), f"hardwood_{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(called)
        out = self.spark.table(called)
        self.paths[id(out)], self.tables[id(out)] = (path, out), called
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            if id(t) in self.tables:
                self.spark.sql(f"drop table if exists {self.tables.pop(id(t))}")
            delete_folder(self.spark, path)


#: Keys that hold so many rows may be met apart from the rest, so many keys at most.
HOT_ROWS, HOT_KEYS = 1000, 1024


def join_hot(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined by ``key`` (inner or left) with ``one``, which has a row a key at most.

    The HOT_KEYS keys with the most rows are met by a broadcast of their rows of ``one``, as many at
    most, so that no task gets all rows of a frequent key: what is left of any key is less than a
    1/HOT_KEYS share of all rows, or HOT_ROWS. A frequent key that ``one`` lacks is told as well, and null
    keys, which meet nothing, aren't shuffled.
    """
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__c")).where(F.col("__c") >= HOT_ROWS).orderBy(F.desc("__c"), key).limit(HOT_KEYS).select(key)
    there = one.join(F.broadcast(hot), key, "left_semi").withColumn("__there", F.lit(True))
    few = hot.join(there, key, "left").withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(few), key, "left")
    settled = F.col("__there").isNotNull() if how == "inner" else F.col("__hot").isNotNull() | F.col(key).isNull()
    apart = met.where(settled).drop("__hot", "__there")
    rest = met.where(F.col("__hot").isNull() & F.col(key).isNotNull()).select(*rows.columns).join(one, key, how)
    return apart.unionByName(rest)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def id_or_last(c: Column | str = "doc_id") -> Column:
    """doc_id with NO_ID for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NO_ID)).cast("long")


def id_back(c: Column) -> Column:
    return F.when(c != F.lit(NO_ID), c)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []
