"""Lempel-Ziv phrase fingerprints of documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.llm.common import table, written

#: Symbols of the parse: words, long ones in parts.
SYMBOL = re.compile(r"[^\x20\x09-\x0D]{1,12}")
#: Minimum hashes in a fingerprint, 16 bits each.
HASHES = 64
MASK, STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240101)
MULTIPLY = _random.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, np.uint64)
CACHE_SYMBOLS = 300_000
_hashes: dict[str, int] = {}


def phrases(text: str) -> set[int]:
    """Hashes of the phrases of a dictionary parse: each phrase is the longest one met before and one symbol more."""
    if len(_hashes) > CACHE_SYMBOLS:
        _hashes.clear()
    met, now, known = set(), 0, _hashes
    for s in SYMBOL.findall(text):
        h = known.get(s)
        if h is None:
            raw = s.encode("utf-8", "replace")
            h = known[s] = (zlib.crc32(raw) << 32 | zlib.adler32(raw, 7)) * STEP & MASK
        now = ((now ^ h) * STEP + h) & MASK
        if now not in met:
            met.add(now)
            now = 0
    return met


def signature(text: str | None) -> np.ndarray:
    """Least hash of the phrases under each of HASHES functions, its top 16 bits; all 0xFFFF without phrases."""
    met = phrases(text or "")
    if not met:
        return np.full(HASHES, 0xFFFF, np.uint16)
    x = np.fromiter(met, np.uint64, len(met))
    x ^= x >> np.uint64(31)
    low = np.full(HASHES, MASK, np.uint64)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * MULTIPLY + ADD).min(0))
    # The least values share their leading bits, so they are mixed before they are cut.
    low = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (low >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` whose last half is replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(doc_id, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_signature = own if changed == text else signature(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), own.astype("<u2").tobytes().hex(),
        changed_signature.astype("<u2").tobytes().hex(), likeness(own, changed_signature), likeness(own, other),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, with those of their edited texts and their likeness.

    The edited text of a document takes the place of its last half from the beginning of the next
    document in descending order of doc_id; the last is followed by the first. A null text is
    empty; null doc_ids come last; equal doc_ids follow each other by a hash of their texts.
    Repeated rows follow each other. Extra columns are ignored; an empty table gives no rows.

    Texts are shuffled once, into ranges of doc_id; within a range each document meets the next as
    they stream by, so a task holds two at a time. Only the texts at the ends of ranges, two a
    range, meet in a join afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def out(done, ends):
            # place: 0 judged, 1 the range's last document, 2 its first
            full = [(*r, 0, part, None) for r in done] + [(i, None, None, None, None, None, None, place, part, t) for place, i, t in ends]
            kinds = [*KINDS, pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], k) for i, k in enumerate(kinds)], [*NAMES, "place", "part", "text"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece, done, ends = batch.slice(at, 256), [], []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    own = last[2] if last and last[1] == text else signature(text)
                    if last is None:
                        ends.append((2, doc_id, text))
                    else:
                        done.append(_judged(*last, text, own))
                    last = (doc_id, text, own)
                yield out(done, ends)
        if last is not None:
            yield out([], [(1, last[0], last[1])])

    both = written(ranged.mapInArrow(run, f"{DDL}, place int, part int, text string"), "fingerprints")
    firsts = both.where("place = 2").select("part", F.col("text").alias("following"))
    # One row per range of doc_ids.
    ring = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    lasts = both.where("place = 1").select("part", "doc_id", "text").join(ring, "part")
    pairs = lasts.select("doc_id", "text", "next_part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_judged(r["doc_id"], r["text"], signature(r["text"]), r["following"], signature(r["following"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(KINDS)], NAMES)

    return both.where("place = 0").select(*NAMES).union(pairs.mapInArrow(finish, DDL))


def op8_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
