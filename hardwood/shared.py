"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs in one process (tests, a laptop) a temporary
    folder is set instead; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("hardwood.shared.dir", None)
    if named is None:
        there = sc._jsc.sc().getCheckpointDir()
        if not there.isDefined() and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = there.get() if there.isDefined() else f"file://{tempfile.mkdtemp(prefix='hardwood-')}"
        if not there.isDefined():
            sc.setCheckpointDir(named)
        spark.conf.set("hardwood.shared.dir", named)
    at = sc._jvm.org.apache.hadoop.fs.Path(named)
    full = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hardwood/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed once, and
    nothing of it is lost with an executor.

    ``group_rows``, for rows of many KB: so many rows at most are a row group. A task holds one while it writes or reads,
    and Parquet's own bound, 128 MB, is of compressed bytes, which it looks at every 100 rows or less often.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    groups = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.options(compression="zstd", **groups).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as the session shuffles into, for steps whose work lies in rows, not bytes.

    Without a number Spark merges parts of few bytes, down to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
