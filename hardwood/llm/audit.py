"""Filter interaction audit: packed bitmaps of filters, labels and parts, counted for every order of the filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.llm.common import NO_ID, id_or_last, in_small_batches, join_hot, table, written

FILTERS = "ABCDE"
#: Fewest words; percent of words that differ at least; percent of capitals at most; characters that fail a text.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: Bits of a document's flags: filters A to E, then the labels.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
#: Texts beyond so many bytes are split into words in slices.
SLICE = 1 << 20
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 20_000
CAPITALS = bytes(range(65, 91))
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; bytes.split() splits on exactly the six ASCII spaces.

    A long text is taken in slices, of whose words only 64-bit hashes stay.
    """
    if len(text) <= SLICE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, np.zeros(0, np.int64), 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end : end + 1] not in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
            end += 1
        words = text[at:end].split()
        n, at = n + len(words), end
        seen = np.union1d(seen, np.fromiter(map(hash, set(words)), np.int64))
    return n, len(seen)


def judge_texts(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Flags of filters A to D and a digest of each text; null is empty."""
    texts = pc.fill_null(texts, "")
    raw = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.match_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False)
    flags, digests = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(raw):
        text = t.as_py()
        n, distinct = word_counts(text)
        capitals = len(text) - len(text.translate(None, CAPITALS))
        flags[i] = (n < FEWEST_WORDS) | (100 * distinct < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * int(chars[i])) << 2
        digests.append(hashlib.blake2b(text, digest_size=16).digest())
    return flags | symbols.astype(np.int64) << 3, digests


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flags, digests = judge_texts(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(flags), pa.array(digests, pa.binary())], ["doc_id", "part", "flags", "digest"])


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and flags of each document: bits of the filters that it fails, in order, then GOOD and TOXIC."""
    rows = docs.select(id_or_last().alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = written(in_small_batches(rows).mapInArrow(_judged, "doc_id long, part string, flags long, digest binary"), "audit-flags")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    rows = join_hot(rows, first, "digest", "left")
    marks = labels.where(F.col("doc_id") < NO_ID).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = join_hot(rows, marks.where("good + toxic > 0"), "doc_id", "left")
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    more = bit(F.col("doc_id") > F.col("first"), 1 << 4) + bit(F.col("good") == 1, GOOD) + bit(F.col("toxic") == 1, TOXIC)
    return rows.select("part", (F.col("flags") + more).alias("flags"))


def _prefixes() -> list[tuple[int, int]]:
    """(subset of filters applied before, next filter): the set's bits and the filter's place."""
    places = range(len(FILTERS))
    return [(sum(1 << p for p in s), f) for f in places for k in places for s in combinations([p for p in places if p != f], k)]


def count_prefixes(codes: np.ndarray, flags: np.ndarray, parts: int) -> np.ndarray:
    """COUNTS by part and (prefix subset, filter) of ``_prefixes()``, from bitmaps: a part is a range of 64-bit words.

    Every prefix subset's dead rows are the union of its filters' bitmaps; AND, AND-NOT and popcount do the rest.
    """
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=parts)
    words = np.maximum(-(-sizes // 64), 1)
    starts = np.concatenate([[0], np.cumsum(words)[:-1]])
    rank = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(starts, sizes) * 64 + rank

    def bitmap(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(words.sum()) * 64, bool)
        bits[at] = rows
        return np.packbits(bits, bitorder="little").view(np.uint64)

    flags = flags[order]
    here, good, toxic = bitmap(np.ones(len(flags), bool)), bitmap(flags & GOOD > 0), bitmap(flags & TOXIC > 0)
    fails = [bitmap(flags >> p & 1 > 0) for p in range(len(FILTERS))]
    dead = [np.zeros_like(here)]
    for s in range(1, 1 << len(FILTERS)):
        low = (s & -s).bit_length() - 1
        dead.append(dead[s & (s - 1)] | fails[low])
    pop = lambda b: np.add.reduceat(np.bitwise_count(b).astype(np.int64), starts)
    out = []
    for s, f in _prefixes():
        gone = fails[f] & ~dead[s]
        out.append([pop(here & ~(dead[s] | fails[f])), pop(gone), pop(fails[f] & dead[s]), pop(gone & good), pop(gone & toxic)])
    return np.moveaxis(np.array(out), 2, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``count_prefixes`` over a partition's batches, a row a part and prefix; many parts are handed on early."""
    subsets, filters = (np.array(c) for c in zip(*_prefixes(), strict=True))

    def rows(held: dict) -> pa.RecordBatch:
        each = len(subsets)
        counts = np.concatenate(list(held.values())).T
        names = pa.array([p for p in held for _ in range(each)], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(np.tile(subsets, len(held))), pa.array(np.tile(filters, len(held))), *map(pa.array, counts)], ["part", "subset", "filter", *COUNTS])

    held: dict[str, np.ndarray] = {}
    for b in batches:
        coded = b.column("part").dictionary_encode()
        names = coded.dictionary.to_pylist()
        counts = count_prefixes(coded.indices.to_numpy().astype(np.int64), b.column("flags").to_numpy(), len(names))
        for name, c in zip(names, counts, strict=True):
            held[name] = held[name] + c if name in held else c
        if len(held) >= HELD_PARTS:
            yield rows(held)
            held = {}
    if held:
        yield rows(held)


def _orders(spark: SparkSession) -> DataFrame:
    """The 600 places in the 120 orders: filter_order, step, subset applied before, filter."""
    rows = [("".join(o), i + 1, sum(1 << FILTERS.index(f) for f in o[:i]), FILTERS.index(f)) for o in permutations(FILTERS) for i, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, subset long, filter long")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null: empty), order of the filters and step, as the package's contract for op12 says:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` (doc_id, text, source), ``labels`` (doc_id, quality, toxic). A null text is empty, and equal to other
    empty ones. E compares whole texts over the whole table, by a 128-bit digest; a row without a doc_id
    comes after all that have one, and rows that repeat a doc_id don't fail each other. A document that several
    labels name is good or toxic if one of them says so. Rows repeat as they are; extra columns are ignored; an
    empty table gives no rows.

    Texts are read once and only flags and digests are shuffled; bitmaps stay in their task, and 80 counts a part
    leave it.
    """
    spark = docs.sparkSession
    sums = flagged(docs, labels).mapInArrow(_counted, ", ".join(["part string", "subset long", "filter long", *(f"{c} long" for c in COUNTS)]))
    sums = sums.groupBy("part", "subset", "filter").agg(*(F.sum(c).alias(c) for c in COUNTS))
    whole, most = Window.partitionBy("part", "filter"), len(FILTERS)
    others = F.col("subset") == (1 << most) - 1 - F.pow(F.lit(2), "filter").cast("long")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(most - 1 - k)) for k in range(most))), F.bit_count("subset") + 1)
    sums = sums.withColumns({"unique_fails": F.max(F.when(others, F.col("removed"))).over(whole), "shapley": F.sum(ways * F.col("removed")).over(whole)})
    out = sums.join(F.broadcast(_orders(spark)), ["subset", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = r"""with t as (select doc_id, coalesce(source,'') part, coalesce(text,'') text from documents),
 w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words from t),
 b as (select part, doc_id, len(words)<200 a, 100*list_unique(words)<50*len(words) b, 100*(length(text)-length(regexp_replace(text,'[A-Z]','','g')))>2*length(text) c, regexp_matches(text,'[#$%&*|]') d, coalesce(min(doc_id) over (partition by text)<doc_id, false) e from w),
 l as (select doc_id, bool_or(coalesce(quality=1,false)) good, bool_or(coalesce(toxic=1,false)) toxic from labels group by doc_id),
 f as (select part, cast(a as int)+2*cast(b as int)+4*cast(c as int)+8*cast(d as int)+16*cast(e as int) m, coalesce(good,false) good, coalesce(toxic,false) toxic, count(*) n from b left join l using (doc_id) group by all),
 x as (select range k, substr('ABCDE',cast(range+1 as int),1) c from range(5)),
 o as (select v.c||w.c||x.c||y.c||z.c filter_order, [v.k,w.k,x.k,y.k,z.k] ks from x v, x w, x x, x y, x z where len(list_distinct([v.k,w.k,x.k,y.k,z.k]))=5),
 s as (select filter_order, cast(i.range+1 as int) step, ks[i.range+1] k, cast(coalesce(list_sum([1<<q for q in ks[1:i.range]]),0) as int) before from o, range(5) i),
 g as (select part, filter_order, step, k, sum(n) filter (where (m & (before | (1<<k)))=0) kept, sum(n) filter (where (m & before)=0 and (m>>k)&1=1) removed, sum(n) filter (where (m & before)<>0 and (m>>k)&1=1) redundant,
  sum(n) filter (where m=(1<<k)) unique_fails, sum(n) filter (where (m & before)=0 and (m>>k)&1=1 and good) good_lost, sum(n) filter (where (m & before)=0 and (m>>k)&1=1 and toxic) toxic_lost from f, s group by all)
 select part, filter_order, step, cast(coalesce(kept,0) as bigint) kept, cast(coalesce(removed,0) as bigint) removed, cast(coalesce(redundant,0) as bigint) redundant, cast(coalesce(unique_fails,0) as bigint) unique_fails, cast(coalesce(good_lost,0) as bigint) good_lost, cast(coalesce(toxic_lost,0) as bigint) toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, k),0) as bigint) shapley from g"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
