"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hardwood.llm.common import id_or_last, table, written

CELL_BITS = 16


def _point(what: str) -> int:
    return int.from_bytes(hashlib.blake2b(what.encode(), digest_size=8).digest(), "big")


def place_cells(loads: dict[int, int], shards: int, vnodes: int, slack: float, bits: int = CELL_BITS):
    """Walk the ring: each cell's load goes to the next virtual node clockwise whose shard has
    room, and what doesn't fit continues clockwise.

    ``loads`` has the bytes of each of at most 2**bits ring cells, so this is bounded work
    whatever the input's size. Returns ``(cell, part, start, shard)`` rows: from byte ``start``
    of the cell's rows in ring order on, ``shard`` takes them.
    """
    total = sum(loads.values())
    room = [math.ceil(total * (1 + slack) / shards)] * shards
    ring = sorted((_point(f"shard {s} node {v}") >> (64 - bits), s) for s in range(shards) for v in range(vnodes))
    at, owner, n = [p for p, _ in ring], [s for _, s in ring], len(ring)
    onward = list(range(n))  # the next virtual node, at or after this one, whose shard has room

    def free(i: int) -> int:
        seen = []
        while room[owner[onward[i]]] <= 0:
            seen.append(i)
            i = (onward[i] + 1) % n
        for j in seen:
            onward[j] = onward[i]
        return onward[i]

    parts = []
    for cell in sorted(loads, key=lambda c: _point(f"cell {c}")):
        left, start, part, i = loads[cell], 0, 0, bisect_left(at, cell) % n
        while left > 0:
            i = free(i)
            put = min(left, room[owner[i]])
            parts.append((cell, part, start, owner[i]))
            room[owner[i]] -= put
            left, start, part = left - put, start + put, part + 1
    return parts


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 200, slack: float = 0.001) -> DataFrame:
    """Deal documents out to ``shards`` shards by a consistent-hash ring with bounded loads.

    A document hashes to one of 2**16 ring cells. A shard takes at most ``1 + slack`` times the
    mean bytes, give or take half a document where it fills up; later cells pass it by and continue
    clockwise, so the shards' bytes stay near equal while another shard moves little.

    Returns doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard). A null text
    has no bytes and checksum 0. Rows with a null doc_id hash by their text. Repeated rows are
    dealt out one by one. Extra columns are ignored; an empty table gives no rows.

    Only the cell totals (2**16 at most) reach the driver; documents meet others only within
    their cell, and texts are read once and never shuffled.
    """
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    crc = F.crc32(text)
    h = F.xxhash64(id_or_last(), F.when(F.col("doc_id").isNull(), crc))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), crc.cast("long").alias("crc"), h.alias("h"))
    slim = slim.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int"))
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "crc", "size")
    ranked = written(
        slim.withColumn("row", F.row_number().over(order) - 1)
        .withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select("doc_id", "size", "crc", "cell", "row", "start"),
        "shard-rank",
    )
    spark = docs.sparkSession
    loads = {r[0]: r[1] for r in ranked.groupBy("cell").agg(F.sum("size")).collect()}
    parts = place_cells(loads, shards, vnodes, slack)
    by_cell: dict[int, list] = {}
    for cell, part, start, shard in parts:
        by_cell.setdefault(cell, []).append((start, part, shard))
    places = spark.createDataFrame(sorted(by_cell.items()), "cell int, parts array<struct<start:long,part:int,shard:int>>")
    took = F.expr("element_at(filter(parts, p -> p.start <= start + size div 2), -1)")
    placed = ranked.join(F.broadcast(places), "cell").withColumn("took", took).select("doc_id", "size", "crc", "cell", "row", "took.part", "took.shard")
    # Where each part of a cell begins among the rows of its shard.
    counts = sorted(placed.groupBy("shard", "cell", "part").agg(F.count("*"), F.min("row")).collect())
    offsets, sums = [], [0] * shards
    for shard, cell, part, n, first in counts:
        offsets.append((cell, part, sums[shard] - first))
        sums[shard] += n
    shift = spark.createDataFrame(offsets, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("shift", T.LongType())]))
    return placed.join(F.broadcast(shift), ["cell", "part"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot")
    )


def op1_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to shards 0 to 39; the law that holds is ``bytes``."""
    out = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
