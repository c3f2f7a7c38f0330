"""Target-distribution importance resampling: hashed n-gram counts as CSR blocks, gains of buckets, drawn documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import in_small_batches, table, written
from hardwood.operators.ranges import numbered

#: Buckets of features, percent of the documents drawn, fewest words of a document that may be drawn, seed of the draw.
BUCKETS, PERCENT, FEWEST_WORDS, SEED = 10_000, 25, 20, 7
#: Texts are cut into words in slices of about so many bytes.
SLICE = 1 << 20
#: A block is full with so many stored counts and documents; blocks that a task holds at once as it writes or reads them.
BLOCK, HELD_BLOCKS = 1 << 16, 16
# Bytes that are no word's are spaces, A-Z are lower-cased: words are runs of 0-9, letters and bytes beyond ASCII.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

BLOCKS = "doc_ids array<bigint>, n_words binary, indptr binary, indices binary, counts binary, width int"


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """Lists of a text's words, in order; a slice ends at the end of a word."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and TO_WORDS[text[end]] != 32:
            end += 1
        yield text[at:end].translate(TO_WORDS).split()
        at = end


def feature_counts(text: bytes | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets that a text's words and pairs of words fall into, their counts, and the number of words.

    A pair's checksum goes on from that of its first word and the space, so no pair is put together.
    """
    counts, n, last = np.zeros(buckets, np.int64), 0, []
    for words in word_slices(text or b""):
        run = last + words
        sums = list(map(crc32, run))
        pairs = map(crc32, run[1:], map(crc32, repeat(b" "), sums))
        found = np.fromiter(chain(sums[len(last) :], pairs), np.int64)
        counts += np.bincount(found % buckets, minlength=buckets)
        n, last = n + len(words), run[-1:]
    at = np.flatnonzero(counts)
    return at, counts[at], n


def _block(rows: list[tuple], kind: type) -> pa.RecordBatch:
    """One row of BLOCKS of documents (doc_id, buckets, counts, words)."""
    indptr = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    indices, counts = np.concatenate([r[1] for r in rows]).astype(kind), np.concatenate([r[2] for r in rows])
    counts = counts.astype(np.min_scalar_type(counts.max(initial=0)))
    block = [[r[0] for r in rows], np.array([r[3] for r in rows]).tobytes(), indptr.tobytes(), indices.tobytes(), counts.tobytes(), counts.itemsize]
    types = [pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def count_blocks(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of documents (doc_id, text) by buckets, one CSR block a row: indptr (int64), indices (uint16, or
    uint32 beyond 65,536 buckets), counts (unsigned, of ``width`` bytes, as few as hold the block's largest), and the words
    of each document. A block ends with the document that brings it to BLOCK, a stored count and a document counting one each."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
            rows, held = [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), raw, strict=True):
                rows.append((i, *feature_counts(t.as_py(), buckets)))
                held += len(rows[-1][1]) + 1
                if held >= BLOCK:
                    yield _block(rows, kind)
                    rows, held = [], 0
            if rows:
                yield _block(rows, kind)

    return in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, BLOCKS)


def _blocks(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, words, indptr, indices and counts of the blocks of a batch."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for r in batch.to_pylist():
        counts = np.frombuffer(r["counts"], f"u{r['width']}").astype(np.int64)
        yield r["doc_ids"], np.frombuffer(r["n_words"], np.int64), np.frombuffer(r["indptr"], np.int64), np.frombuffer(r["indices"], kind), counts


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Count of each bucket over all blocks: summed in each task, then by bucket; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, indices, counts in _blocks(b, buckets):
                np.add.at(total, indices, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = blocks.select("doc_ids", "n_words", "indptr", "indices", "counts", "width").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much likelier, in thousandths of a natural logarithm, a bucket is in the target than in the corpus; floored."""
    k = float(len(raw))
    ratio = ((target + 1.0) * (float(raw.sum()) + k)) / ((raw + 1.0) * (float(target.sum()) + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features, by a sparse product of
    its row with ``gains``; 0 without features."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n_words, indptr, indices, counts in _blocks(b, buckets):
                cumulated = lambda v: np.concatenate([[0], np.cumsum(v)])[indptr]
                n, gain = np.diff(cumulated(counts)), np.diff(cumulated(counts * gains[indices]))
                weight = np.where(n > 0, gain // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text): documents like those of
    ``target`` (text) are drawn, without replacement, by perturbed weights; rank is null where a document isn't drawn.

    Of the N documents with at least ``fewest_words`` words floor(percent * N / 100) are drawn. A null text has no words;
    a text without words has no features and weight 0. The noise hashes ``seed:doc_id``, with nothing after the colon
    for a null doc_id; such rows come last of equal scores, then rows as they were written. Rows that
    repeat a doc_id share its noise and are drawn one by one. Extra columns are ignored; an empty table gives no rows,
    an empty target gains that are the same for equal counts.

    Texts are read once into CSR blocks in the shared folder; the column sums, ``buckets`` numbers, are all that passes
    through the driver. Ranks come from ranges, so no task sorts all documents.
    """
    blocks = written(count_blocks(docs, buckets), "csr", HELD_BLOCKS)
    aimed = written(count_blocks(target.select(F.lit(0).alias("doc_id"), "text"), buckets), "csr-target", HELD_BLOCKS)
    rows = weigh(blocks, bucket_gains(column_sums(blocks, buckets), column_sums(aimed, buckets)))
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(noise, 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn("score", F.col("weight") + gumbel), "importance")
    enough = F.col("n_words") >= fewest_words
    most = rows.where(enough).count() * percent // 100
    able = numbered(rows.where(enough), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features")
    able = able.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    out = able.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
