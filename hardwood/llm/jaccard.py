"""Exact n-gram Jaccard join by pivots, Voronoi regions and triangle-inequality windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import Scratch, in_small_batches, join_hot, table, written

WORDS, PERCENT = 5, 75
#: Counters of shingles are dealt into ranges of values, each with 2**COUNTER_BITS counters; bits of the bitmap made of them.
RANGE_BITS, COUNTER_BITS, FLAG_BITS = 12, 20, 27
#: Shingles counted so often come last in the order of shingles, but at most those of one bit in MANY.
MANY = 16
#: Shingles of a range that are counted by sorting; of more, in counters. Both give the same.
FEW = 1 << 17
#: Shingles counted, and entries of prefixes sent, in a run; entries of prefixes that meet at once.
RUN_SHINGLES, RUN_ENTRIES, MEET_ENTRIES = 4_000_000, 1_000_000, 1 << 20
#: Blocks of at most so many sets are compared by pairs; of larger ones, so many sets are in a row.
SMALL, PART = 16, 1000
#: Rounds of pivots in which large regions are split before what is left of them is compared in chunks.
ROUNDS = 3
#: Bits of the bitmap that says which sets are needed: so many for each, up to a bound.
NEED_BITS, MOST_BITS = 16, 1 << 27
#: Shingles, and sets, in a chunk of sets that are compared with those of another; columns compared at once.
CHUNK, CHUNK_SETS, SLICE = 200_000, 2_000, 4096
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 19
M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
# Fixed value: the six ASCII white-space characters.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(M1))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` begin, and their hashes: sums of a value for each byte times one for its place."""
    text = np.frombuffer(raw, np.uint8)
    inside = ~SPACE[text]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), M1, np.uint64))
    return starts, _mix(np.add.reduceat(BYTE_VALUES[text[inside]] * powers[place], first))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total *= np.uint64(M1)
        total += h[k : k + len(total)]
    return _mix(total)


def shingle_sets(texts: Iterable[str | None], width: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted 64-bit hashes of its distinct word shingles; of the whole
    sequence if it is shorter. Texts are hashed together, about TOGETHER bytes at a time."""

    def sets() -> Iterator[np.ndarray]:
        starts, h = _word_hashes(b"\n".join(held))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)])).tolist()
        rolled = _rolled(h, width) if len(h) >= width else None
        for x, y in zip(bounds, bounds[1:], strict=False):
            if x == y:
                yield h[:0]
                continue
            s = np.sort(rolled[x : y - width + 1]) if y - x >= width else _rolled(h[x:y], y - x)
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]

    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "replace").lower() if text else b"")
        size += len(held[-1])
        if size > TOGETHER:
            yield from sets()
            held, size = [], 0
    if held:
        yield from sets()


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    return next(shingle_sets([text], width))


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (v.as_py() for v in batch.column(1))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Two sets that link share one of their first so many shingles, in any common order."""
    return n - -(-percent * n // 100) + 1



def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


# --- Blocks: sets that share a shingle of their prefixes ----------------------------------------


def _flags_by_counters(count: np.ndarray) -> bytes:
    """A range's part of the bitmap: the bits of counters of MANY or more, at most one bit in MANY."""
    most = count.reshape(-1, 1 << (RANGE_BITS + COUNTER_BITS - FLAG_BITS)).max(1)
    cut = np.partition(most, -(len(most) // MANY))[-(len(most) // MANY)]
    return np.packbits((most >= MANY) & (most > cut)).tobytes()


def _flags_by_sorting(values: np.ndarray) -> bytes:
    """What ``_flags_by_counters`` gives for the counters of ``values``, in time that follows their number."""
    shift = RANGE_BITS + COUNTER_BITS - FLAG_BITS
    flags, share = np.zeros(1 << (COUNTER_BITS - shift), bool), (1 << (COUNTER_BITS - shift)) // MANY
    values, n = np.unique(values, return_counts=True)
    bits = values >> shift
    starts = np.flatnonzero(np.diff(bits, prepend=-1))
    most = np.maximum.reduceat(n, starts) if len(starts) else n
    cut = np.partition(most, -share)[-share] if len(most) >= share else 0
    flags[bits[starts[(most >= MANY) & (most > cut)]]] = True
    return np.packbits(flags).tobytes()


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """A bitmap of FLAG_BITS bits that is set for the most frequent shingles, and the number of shingles.

    Tasks send 16 bits of each shingle of their distinct sets, sorted, in runs of one range of values;
    a range's runs are read one after another into 2**COUNTER_BITS counters, or sorted if they are
    short. Set are the bits of counters of MANY or more, but at most one in MANY of all. So memory is the same whatever the
    input. The bitmap only orders shingles: any bitmap gives the same links.
    """
    step = 1 << (16 - RANGE_BITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            h = np.sort(np.concatenate(held))
            held.clear()
            ends = np.searchsorted(h, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(16))
            low, runs = h.astype("<u2"), []
            for i in range(0, 1 << 16, step):
                x, y = ends[i], ends[i + step]
                if y > x:
                    runs.append((i // step, np.diff(ends[i : i + step + 1]).astype("<u4").tobytes() + low[x:y].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in runs], pa.int32()), pa.array([x for _, x in runs], pa.binary())], ["range", "run"])

        held, size, seen = [], 0, set()
        for batch in batches:
            for s in shingle_sets(_texts(batch), width):
                if not len(s) or _again(seen, set_id(s)):
                    continue
                held.append(s >> np.uint64(32))
                size += len(s)
                if size > RUN_SHINGLES:
                    yield out()
                    size = 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add():
            if held:
                count[:] = np.minimum(count + np.bincount(np.concatenate(held), minlength=len(count)), 1 << 30)
                held.clear()

        def out():
            if full or size > FEW:
                add()
                raw, n = _flags_by_counters(count), int(count.sum())
                count[:] = 0
            else:
                raw, n = _flags_by_sorting(np.concatenate(held)), size
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary()), pa.array([n], pa.int64())], ["range", "flags", "n"])

        at, held, size, full, count = None, [], 0, False, np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for i, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield out()
                    at, size, full = i, 0, False
                raw = run.as_py()
                held.append((np.repeat(np.arange(step), np.frombuffer(raw, "<u4", step)) << 16) | np.frombuffer(raw, "<u2", offset=4 * step))
                size += len(held[-1])
                if size > RUN_SHINGLES:
                    add()
                    size, full = 0, True
        if at is not None:
            yield out()

    runs = in_small_batches(docs).mapInArrow(send, "range int, run binary").repartition("range").sortWithinPartitions("range")
    flags, total = np.zeros(1 << (FLAG_BITS - 3), np.uint8), 0
    size = len(flags) >> RANGE_BITS
    for i, raw, n in runs.mapInArrow(meet, "range int, flags binary, n long").collect():
        flags[i * size : (i + 1) * size] = np.frombuffer(raw, np.uint8)
        total += n
    return flags, total


def _again(seen: set, own: int) -> bool:
    """Whether a task has met a set before; it remembers a million."""
    if own in seen:
        return True
    if len(seen) > 1_000_000:
        seen.clear()
    seen.add(own)
    return False


FOUND = "kind int, range int, doc_id long, set long, n long, run binary"
OWN, ENTRIES, HOT, BLOCK = range(4)


def _found(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, row) doc_id, row, set (its hash) and n (its size); and
    blocks: block, size and sets, the sets that have a shingle in their prefixes, two or more.

    A prefix is the first quarter of a set, frequent shingles last, and else in the order of their
    hashes. A run is one range of hashes: six bytes of each and the sets' hashes. A shingle that a
    task finds in more than SMALL sets makes a block there, and only one of its sets goes on to meet
    those of other tasks, so that a range gets at most SMALL sets a shingle and run. Such blocks are
    in several rows, of size SMALL + 1 at least.
    """
    flags, total = _frequent(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    bits = min(24, max(RANGE_BITS, int(total * (100 - percent) / 100 / MEET_ENTRIES).bit_length()))

    def rows(kind, ranges, doc_ids=None, sets=None, sizes=None, runs=None) -> pa.RecordBatch:
        n = len(ranges)
        arrays = [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(ranges, np.int32))]
        arrays += [pa.nulls(n, pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in (doc_ids, sets, sizes)]
        arrays.append(pa.array(runs, pa.binary()) if isinstance(runs, list) else runs)
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in FOUND.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen, keys, owners, size, nth = shared.value, set(), [], [], 0, 0

        def entries(kind, key, own):
            at = (key >> np.uint64(64 - bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
            low = np.ascontiguousarray((key >> np.uint64(4)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
            return rows(kind, at[starts], runs=[low[x:y].tobytes() + own[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(at)], strict=True)])

        def out():
            key, own = np.concatenate(keys), np.repeat([o for o, _ in owners], [n for _, n in owners])
            keys.clear()
            owners.clear()
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            count = np.diff(np.append(starts, len(key)))
            hot = starts[count > SMALL]
            if len(hot):
                many = count[count > SMALL]
                blocks = [own[x + 1 : x + c].tobytes() for x, c in zip(hot.tolist(), many.tolist(), strict=True)]
                yield rows(BLOCK, (nth + np.arange(len(hot))) % (1 << bits), sets=(key[hot] >> np.uint64(4)).astype(np.int64), sizes=many, runs=blocks)
                yield entries(HOT, key[hot], own[hot])
            few = np.repeat(count <= SMALL, count)
            if few.any():
                yield entries(ENTRIES, key[few], own[few])

        for batch in batches:
            sets, sizes = [], []
            for s in shingle_sets(_texts(batch), width):
                own = set_id(s)
                sets.append(own)
                sizes.append(len(s))
                if not len(s) or _again(seen, own):
                    continue
                at = s >> np.uint64(64 - FLAG_BITS)
                many = (flags[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
                keys.append(np.concatenate([s[~many], s[many]])[: prefix_size(len(s), percent)])
                owners.append((own, len(keys[-1])))
                size += len(keys[-1])
                if size > RUN_ENTRIES:
                    yield from out()
                    size = 0
            yield rows(OWN, (nth + np.arange(len(sets))) % (1 << bits), batch.column(0), sets, sizes, batch.column(2))
            nth += len(sets)
        if size:
            yield from out()

    def made(own, blocks=None, sizes=None, lists=None) -> pa.RecordBatch:
        n = len(blocks) if own is None else own.num_rows
        none = pa.nulls(n, pa.int64())
        if own is not None:
            arrays = [*(own.column(c) for c in ("doc_id", "set", "n", "run")), none, none, pa.nulls(n, pa.list_(pa.int64()))]
        else:
            arrays = [none, none, none, pa.nulls(n, pa.binary()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "set", "n", "row", "block", "size", "sets"])

    def lists_of(counts, values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, pa.int64()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            key, own, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((own, key))
            key, own, hot = key[order], own[order], hot[order]
            # The same set from two tasks is one.
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1]))))
            key, own, hot = key[first], own[first], np.logical_or.reduceat(hot, first)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(starts, len(key)))
            hot = np.logical_or.reduceat(hot, starts)
            keep = (count > 1) | hot
            return made(None, key[starts][keep].astype(np.int64), np.where(hot, np.maximum(count, SMALL + 1), count)[keep], lists_of(count[keep], own[np.repeat(keep, count)]))

        at = None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            own = batch.filter(pa.array(kind == OWN))
            if own.num_rows:
                yield made(own)
            blocks = batch.filter(pa.array(kind == BLOCK))
            if blocks.num_rows:
                values = [np.frombuffer(x, "<i8") for x in blocks.column("run").to_pylist()]
                yield made(None, blocks.column("set").to_numpy(), blocks.column("n").to_numpy(), lists_of([len(v) for v in values], np.concatenate(values)))
            runs = batch.filter(pa.array((kind == ENTRIES) | (kind == HOT)))
            for k, i, run in zip(runs.column("kind").to_pylist(), runs.column("range").to_pylist(), runs.column("run"), strict=True):
                if i != at:
                    if held:
                        yield out()
                    at = i
                raw = run.as_py()
                n = len(raw) // 14
                key = np.zeros((n, 8), np.uint8)
                key[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
                key = key.view("<u8").ravel().astype(np.uint64) | np.uint64((i >> (bits - RANGE_BITS)) << 48)
                held.append((key, np.frombuffer(raw, "<i8", offset=6 * n), np.full(n, k == HOT)))
        if held:
            yield out()

    sent = in_small_batches(docs).mapInArrow(send, FOUND).repartition("range").sortWithinPartitions("range")
    return in_small_batches(sent).mapInArrow(meet, "doc_id long, set long, n long, row binary, block long, size long, sets array<bigint>")


# --- Which pairs can link -------------------------------------------------------------------------


def _size_of_part(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def _prefix_of(n: str, percent: int) -> str:
    return f"({n} - {_size_of_part(n, percent)} + 1)"


def _needed(n: str, m: str, percent: int) -> str:
    """Shingles that the prefixes of two linked sets of these sizes share at least.

    Sets that link share ``percent`` / (100 + percent) of their summed sizes. One prefix ends first
    in the order of shingles; beyond its end its set has a share ``percent`` of its shingles, less
    one; all that is shared before that end is in both prefixes.
    """
    whole = f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    return f"({whole} - greatest({_size_of_part(n, percent)}, {_size_of_part(m, percent)}) + 1)"


def _fits(n: str, m: str, percent: int) -> str:
    """Whether sets of these sizes can link."""
    return f"(100 * least({n}, {m}) >= {percent} * greatest({n}, {m}))"


def _set_info(found: DataFrame, percent: int) -> DataFrame:
    """Of sets in blocks: set, n, hits (its blocks), large (those that are large) and w, the share of
    its prefix that is in blocks: the higher, the nearer to the middle of a group of copies."""
    hits = found.where("block is not null").select(F.explode("sets").alias("set"), (F.col("size") > SMALL).cast("int").alias("large"))
    hits = hits.groupBy("set").agg(F.count("*").alias("hits"), F.sum("large").alias("large"))
    sizes = found.where("block is null and n > 0").groupBy("set").agg(F.max("n").alias("n"))
    return hits.join(sizes, "set").withColumn("w", F.expr(f"hits / {_prefix_of('n', percent)}"))


def _close_pairs(found: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """a, b, wa, wb: the pairs of sets of small blocks that share enough of their prefixes to link.

    A block gives SMALL * (SMALL - 1) / 2 pairs at most. Shingles shared in large blocks aren't
    counted but granted.
    """
    small = found.where(f"size <= {SMALL}").select("sets", F.posexplode("sets").alias("i", "a"))
    pairs = small.select("a", F.explode(F.expr(f"slice(sets, i + 2, {SMALL})")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c"))
    for x in ("a", "b"):
        pairs = pairs.join(info.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("large").alias(f"large{x}"), F.col("w").alias(f"w{x}")), x)
    enough = f"c + least(largea, largeb) >= {_needed('na', 'nb', percent)}"
    return pairs.where(f"{_fits('na', 'nb', percent)} and {enough}").select("a", "b", "wa", "wb")


def _large_blocks(found: DataFrame, info: DataFrame) -> DataFrame:
    """Rows of large blocks as regions: region, set, n, hits and w."""
    return found.where(f"size > {SMALL}").select(F.col("block").alias("region"), F.explode("sets").alias("set")).distinct().join(info.drop("large"), "set")


def _pruned(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``p``, the set of each region with the largest w; without the sets that share too
    little to link with any of a size found there."""
    per = rows.groupBy("region").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.struct("w", "set", "n", "hits")).alias("p"))
    rows = join_hot(rows, per, "region")
    # The number needed rises up to the own size and then falls, so the least is at an end; rounding moves it by one.
    low, high = f"greatest(low, {_size_of_part('n', percent)})", f"least(high, n * 100 div {percent})"
    least = f"least({_needed('n', low, percent)}, {_needed('n', high, percent)}) - 1"
    return rows.where(f"hits >= {least}").drop("low", "high")


# --- Distances --------------------------------------------------------------------------------------


def _needed_bits(spark: SparkSession, sets: DataFrame) -> np.ndarray:
    """A bitmap of NEED_BITS bits for each of ``sets`` (MOST_BITS at most), set at their hashes."""
    n = sets.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (NEED_BITS * n).bit_length()))
    slice_bits = 1 << 15

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at in zip(*(batch.column(k).to_numpy() for k in range(2)), strict=True):
                maps.setdefault(int(i), np.zeros(slice_bits, bool))[at] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["i", "raw"])

    at = F.pmod("set", F.lit(bits))
    rows = sets.select(F.expr(f"pmod(set, {bits}) div {slice_bits}").alias("i"), (at % slice_bits).cast("int").alias("at")).repartition("i").mapInArrow(fold, "i long, raw binary")
    out = np.zeros(bits // 8, np.uint8)
    for i, raw in rows.collect():
        out[i * slice_bits // 8 : (i + 1) * slice_bits // 8] = np.frombuffer(raw, np.uint8)
    return out


def _stored_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (set and more) with ``raw``, the sets' shingles, 64 bits each.

    Texts are hashed again. A bitmap of the wanted sets, of bounded size, drops most others where
    they are; the join drops the rest.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_needed_bits(spark, wanted.select("set")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, seen = shared.value, set()
        for batch in batches:
            ids, raw = [], []
            for s in shingle_sets(_texts(batch), width):
                own = set_id(s)
                at = own % (8 * len(flags))
                if len(s) and flags[at >> 3] >> (7 - (at & 7)) & 1 and not _again(seen, own):
                    ids.append(own)
                    raw.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["set", "raw"])

    rows = in_small_batches(docs).mapInArrow(run, "set long, raw binary")
    return rows.groupBy("set").agg(F.first("raw").alias("raw")).join(wanted, "set")


def _measure(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """set, pivot, d (Jaccard distance) and linked of ``members`` (pivot, salt, set, raw), by ``hubs`` (pivot, salt, raw).

    A pivot's sets are dealt by salt, each part with the pivot before them, and stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            d, linked, kept = [], [], batch.column("set").to_numpy() != batch.column("pivot").to_numpy()
            for member, raw in zip(kept.tolist(), batch.column("raw"), strict=True):
                s = np.frombuffer(raw.as_py(), "<u8")
                if not member:
                    pivot = s
                    continue
                both = overlap(s, pivot)
                union = len(s) + len(pivot) - both
                d.append(1 - both / union)
                linked.append(100 * both >= percent * union)
            part = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([part.column("set"), part.column("pivot"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["set", "pivot", "d", "linked"])

    rows = hubs.select("pivot", "salt", F.col("pivot").alias("set"), "raw", F.lit(0).alias("place")).union(members.select("pivot", "salt", "set", "raw", F.lit(1)))
    rows = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "place").select("set", "pivot", "raw")
    return in_small_batches(rows).mapInArrow(run, "set long, pivot long, d double, linked boolean")


def _salted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (set, pivot) with a salt: PART sets of a pivot share one."""
    many = pairs.groupBy("pivot").agg(F.count("*").alias("many"))
    return join_hot(pairs, many, "pivot").withColumn("salt", F.expr(f"pmod(xxhash64(set), (many + {PART - 1}) div {PART})").cast("int")).drop("many")


def _measure_pairs(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    pairs = _salted(pairs)
    raws = stored.select("set", "raw")
    hubs = pairs.select("pivot", "salt").distinct().join(raws.withColumnRenamed("set", "pivot"), "pivot")
    return _measure(pairs.join(raws, "set"), hubs, percent)


# --- Components ------------------------------------------------------------------------------------


def components(tmp: Scratch, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """set, label: the least set of each connected component of ``links`` (set, pivot), and of those
    that ``labels`` already names.

    Each round a set takes the least label around it and, from the second on, then that label's own
    label, so long chains shorten at least by half; only a flag comes back to the driver.
    """
    if labels is not None:
        for c in ("set", "pivot"):
            links = links.join(labels.select(F.col("set").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
        links = links.where("set != pivot")
    edges = tmp.write(links.select("set", "pivot").union(links.select("pivot", "set")).distinct(), "edges")
    if labels is not None and not edges.limit(1).count():
        tmp.drop(edges)
        return labels
    own = tmp.write(edges.groupBy("set").agg(F.least(F.col("set"), F.min("pivot")).alias("label")), "labels")
    for i in count(1):
        around = join_hot(edges, own.select(F.col("set").alias("pivot"), F.col("label").alias("near")), "pivot").groupBy("set").agg(F.min("near").alias("near"))
        new = tmp.write(own.join(around, "set").select("set", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        tmp.drop(own)
        own = new
        if not new.where("old != label").limit(1).count():
            break
        if i > 1:
            jump = new.select(F.col("set").alias("label"), F.col("label").alias("then"))
            own = tmp.write(join_hot(new, jump, "label").select("set", F.least("label", "then").alias("label")), "labels")
            tmp.drop(new)
    tmp.drop(edges)
    if labels is None:
        return own.select("set", "label")
    to = own.select(F.col("set").alias("label"), F.col("label").alias("then"))
    old = join_hot(labels, to, "label", "left").select("set", F.coalesce("then", "label").alias("label"))
    return tmp.write(old.union(own.select("set", "label").join(labels, "set", "left_anti")), "labels")


def _named(rows: DataFrame, labels: DataFrame, c: str = "set", name: str = "label") -> DataFrame:
    """``rows`` with the label of the set in column ``c``: itself without links."""
    return rows.join(labels.select(F.col("set").alias(c), F.col("label").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))


# --- Regions -----------------------------------------------------------------------------------------


def _unsolved(tmp: Scratch, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """``regions`` (region, set, n, w, dp, dq) with each set's label, the least and greatest label of the
    region (low, high) and its size; without those whose sets all have one label."""
    named = tmp.write(_named(regions, labels), "named")
    mixed = named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low != high")
    out = tmp.write(join_hot(named, mixed, "region"), "regions")
    tmp.drop(named)
    return out


def _pivots(regions: DataFrame) -> DataFrame:
    """``regions`` (as ``_unsolved`` gives them) with their two pivots: p, the set with the largest w,
    and q, that of another label. Regions with the same pivots become one."""
    best = lambda side: F.max(F.when(F.col("label") == F.col(side), F.struct("w", "set")))["set"].alias(side)
    first = F.max(F.struct("w", "set", "label", "low")).alias("p")
    ends = regions.groupBy("region").agg(first, best("low"), best("high"))
    ends = ends.select("region", F.col("p.set").alias("p"), F.when(F.col("p.label") == F.col("p.low"), F.col("high")).otherwise(F.col("low")).alias("q"))
    met = join_hot(regions.select("region", "set", "n", "w"), ends, "region")
    return met.select(F.xxhash64("p", "q").alias("region"), "p", "q", "set", "n", "w").distinct()


def _split(placed: DataFrame, measured: DataFrame, threshold: float) -> DataFrame:
    """The two Voronoi regions of each of ``placed`` (region, set, n, w, p, q), by the distances in
    ``measured``: a set lies in the region of its nearer pivot, and also in the other's unless it is
    more than twice the threshold farther from that one."""
    for c in ("p", "q"):
        d = measured.select("set", F.col("pivot").alias(c), F.col("d").alias(f"d{c}"))
        placed = placed.join(d, ["set", c], "left").withColumn(f"d{c}", F.coalesce(f"d{c}", F.lit(0.0)))
    reach = 2 * threshold + 1e-9
    sides = F.array_compact(F.array(F.when(F.col("dp") <= F.col("dq") + reach, F.lit(0)), F.when(F.col("dq") <= F.col("dp") + reach, F.lit(1))))
    return placed.select(F.explode(sides).alias("side"), "region", "set", "n", "w", "dp", "dq").select(F.xxhash64("region", "side").alias("region"), "set", "n", "w", "dp", "dq")


def _pairs_within(regions: DataFrame, threshold: float, percent: int) -> DataFrame:
    """set, pivot: pairs of different labels within regions of SMALL sets at most, whose sizes and
    distances to the pivots let them link."""
    one = F.struct("set", "n", "label", "dp", "dq")
    each = regions.groupBy("region").agg(F.array_sort(F.collect_list(one)).alias("rows")).select("rows", F.posexplode("rows").alias("i", "x"))
    pairs = each.select("x", F.explode(F.expr(f"slice(rows, i + 2, {SMALL})")).alias("y"))
    near = " and ".join(f"abs(x.{c} - y.{c}) <= {threshold + 1e-9}" for c in ("dp", "dq"))
    return pairs.where(f"x.label != y.label and {_fits('x.n', 'y.n', percent)} and {near}").select(F.col("x.set").alias("set"), F.col("y.set").alias("pivot")).distinct()


def _compare(percent: int):
    """The function that links the sets of two chunks, or of one with itself."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        own, chunk, label = (rows.column(c).to_numpy() for c in ("set", "chunk", "label"))
        raw = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("raw")]
        n = np.array([len(x) for x in raw], np.int64)
        left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
        _, col, count = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(raw)), n)
        keep = count[col] > 1
        col, owner = col[keep], owner[keep]
        order = np.argsort(col, kind="stable")
        col, owner = np.unique(col[order], return_inverse=True)[1], owner[order]
        both = np.zeros((len(left), len(right)), np.float32)
        width = int(col[-1]) + 1 if len(col) else 0
        for at in range(0, width, SLICE):
            x, y = np.searchsorted(col, (at, at + SLICE))
            dense = np.zeros((len(raw), min(SLICE, width - at)), np.float32)
            dense[owner[x:y], col[x:y] - at] = 1
            both += dense[left] @ dense[right].T
        # Of the links, as many as it takes to connect the labels.
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        out = []
        for i, line in zip(left.tolist(), both, strict=True):
            links = ((100 + percent) * line >= percent * (n[i] + n[right])) & (label[right] != label[i])
            for j in right[links].tolist():
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y:
                    root[x] = y
                    out.append((int(own[i]), int(own[j])))
        return pa.table({"set": pa.array([x for x, _ in out], pa.int64()), "pivot": pa.array([y for _, y in out], pa.int64())})

    return run


def _chunk_links(tmp: Scratch, regions: DataFrame, stored: DataFrame, threshold: float, percent: int) -> DataFrame:
    """set, pivot: links that join the labels of what is left of ``regions`` (region, set, n, label, dp, dq).

    Sets are gathered in chunks of bounded size, and two chunks meet once, however many regions they
    share and however many pairs that makes; not if all their sets there have one label, or their
    distances to a pivot differ by more than the threshold. So a set is sent once for each chunk
    that its own meets.
    """
    home = tmp.write(regions.groupBy("set").agg(F.min("region").alias("cell"), F.first("n").alias("n"), F.first("label").alias("label")), "home")
    many = home.groupBy("cell").agg(F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / CHUNK_SETS)).alias("chunks"))
    chunks = join_hot(home, many, "cell").select("set", "label", F.xxhash64("cell", F.pmod(F.xxhash64("set", F.lit(7)), F.col("chunks"))).alias("chunk"))
    chunks = tmp.write(chunks, "chunks")
    window = [f(c).alias(f"{name}_{c}") for c in ("dp", "dq") for name, f in (("low", F.min), ("high", F.max))]
    there = regions.join(chunks.drop("label"), "set").groupBy("region", "chunk").agg(F.min("label").alias("low_label"), F.max("label").alias("high_label"), F.count("*").alias("size"), F.min("n").alias("low_n"), F.max("n").alias("high_n"), *window)
    there = tmp.write(there, "there")
    other = there.select("region", *(F.col(c).alias(f"y_{c}") for c in there.columns if c != "region"))
    near = lambda c: (F.col(f"low_{c}") <= F.col(f"y_high_{c}") + threshold + 1e-9) & (F.col(f"y_low_{c}") <= F.col(f"high_{c}") + threshold + 1e-9)
    fits = (F.col("low_n") * percent <= F.col("y_high_n") * 100) & (F.col("y_low_n") * percent <= F.col("high_n") * 100)
    differ = (F.col("low_label") != F.col("y_high_label")) | (F.col("high_label") != F.col("y_low_label"))
    once = (F.col("chunk") < F.col("y_chunk")) | (F.col("chunk") == F.col("y_chunk")) & (F.col("size") > 1)
    pairs = there.join(other, "region").where(differ & once & fits & near("dp") & near("dq"))
    pairs = tmp.write(pairs.select(F.col("chunk").alias("a"), F.col("y_chunk").alias("b")).distinct(), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    members = tmp.write(chunks.join(stored.select("set", "raw"), "set"), "members")
    links = tmp.write(sides.join(members, "chunk").select("a", "b", "chunk", "set", "label", "raw").groupBy("a", "b").applyInArrow(_compare(percent), "set long, pivot long"), "links")
    tmp.drop(home, chunks, there, pairs, members)
    return links


def _solve_regions(tmp: Scratch, regions: DataFrame, labels: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """The labels after all links within ``regions`` (region, set, n, w) are found.

    Regions whose sets are all connected are done, and those of SMALL sets at most are compared by
    pairs. A larger one gets two pivots, and the distances of its sets to them are measured, which
    links those within the threshold; then it splits in two. What is left after ROUNDS is compared in
    chunks.
    """
    threshold = 1 - percent / 100
    regions = regions.withColumns({"dp": F.lit(0.0), "dq": F.lit(0.0)})
    used: list[DataFrame] = []
    for i in range(ROUNDS + 1):
        left = _unsolved(tmp, regions, labels)
        tmp.drop(*used)
        if not left.limit(1).count():
            tmp.drop(left)
            return labels
        if i == ROUNDS:
            break
        placed = tmp.write(_pivots(left.where(f"size > {SMALL}")), "pivots")
        pairs = placed.where("set != p").select("set", F.col("p").alias("pivot")).union(placed.where("set != q").select("set", "q"))
        pairs = tmp.write(pairs.union(_pairs_within(left.where(f"size <= {SMALL}"), threshold, percent)).distinct(), "pairs")
        measured = tmp.write(_measure_pairs(pairs, stored, percent), "distances")
        labels = components(tmp, measured.where("linked"), labels)
        tmp.drop(left, pairs)
        regions, used = _split(placed, measured, threshold), [placed, measured]
    labels = components(tmp, _chunk_links(tmp, left, stored, threshold, percent), labels)
    tmp.drop(left)
    return labels


def similar_sets(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """set, label for every set that links with another; see ``jaccard_components``."""
    tmp = Scratch(docs.sparkSession)
    info = tmp.write(_set_info(found, percent), "info")
    close = tmp.write(_close_pairs(found, info, percent), "close")
    rows = tmp.write(_large_blocks(found, info), "large")
    tmp.drop(info)
    large = tmp.write(_pruned(rows, percent), "regions")
    tmp.drop(rows)
    # Of each set's candidates the one with the largest w comes first: what most copies are near to.
    can = f"set != p.set and {_fits('n', 'p.n', percent)} and least(hits, p.hits) >= {_needed('n', 'p.n', percent)}"
    up = "struct(wb, b) > struct(wa, a)"
    edges = close.select(F.expr(f"if({up}, a, b)").alias("set"), F.expr(f"if({up}, struct(wb as w, b as set), struct(wa as w, a as set))").alias("to"))
    edges = edges.union(large.where(can).select("set", F.struct("p.w", "p.set")))
    first = tmp.write(edges.groupBy("set").agg(F.max("to")["set"].alias("pivot")), "first")
    cells = tmp.write(_salted(first), "cells")
    hubs = cells.groupBy(F.col("pivot").alias("set")).agg(F.collect_set("salt").alias("salts"))
    wanted = [close.select(F.col("a").alias("set")), close.select("b"), large.select("set"), large.select("p.set")]
    wanted = tmp.write(reduce(DataFrame.union, wanted).distinct().join(cells, "set", "left").join(hubs, "set", "left"), "wanted")
    stored = tmp.write_by(_stored_sets(docs, wanted, width), "sets", "set")
    tmp.drop(first, cells, wanted)
    members = stored.where("pivot is not null")
    measured = tmp.write(_measure(members, stored.where("salts is not null").select(F.col("set").alias("pivot"), F.explode("salts").alias("salt"), "raw"), percent), "distances")
    labels = components(tmp, measured.where("linked"))
    # The other candidates, if they are still apart.
    apart = _named(_named(close, labels, "a", "la"), labels, "b", "lb").where("la != lb")
    done = measured.select(F.least("set", "pivot").alias("a"), F.greatest("set", "pivot").alias("b"))
    rest = apart.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).join(done, ["a", "b"], "left_anti")
    rest = tmp.write(rest.select(F.expr(f"if({up}, a, b)").alias("set"), F.expr(f"if({up}, b, a)").alias("pivot")), "rest")
    more = tmp.write(_measure_pairs(rest, stored, percent), "distances")
    labels = components(tmp, more.where("linked"), labels)
    tmp.drop(measured, rest, more, close)
    labels = _solve_regions(tmp, large.select("region", "set", "n", "w"), labels, stored, percent)
    tmp.drop(large, stored)
    return labels


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two documents link if their word-shingle sets have a Jaccard similarity of ``percent`` or more;
    a component is what links connect, named by its smallest doc_id. The join is exact:

    1. Equal sets are one. Two sets that link share a shingle of their prefixes (a quarter of each
       set, frequent shingles last), so the sets that share one form blocks; others are done.
    2. Pairs of sets in small blocks can link only if their prefixes share enough; those that do are
       compared, each set first with the candidate that is most like a middle of its group.
    3. A large block is a region of the metric space with two pivots, to which its sets' distances
       are measured. Sets within the threshold of a pivot are linked through it. A region whose sets
       are all connected is done.
    4. Other regions split into the pivots' Voronoi regions; by the triangle inequality a set also
       goes to the other region unless it is more than twice the threshold farther from its pivot.
       Regions are joined recursively, small ones by pairs within the windows of their distances.
       What is left after ROUNDS is compared in chunks of bounded size, again within windows.

    A text without words, or null, has no shingles and links with nothing. Rows with a null doc_id
    take part; their component is named by the smallest doc_id that is not null, else null. Rows
    that repeat a doc_id are separate rows. Extra columns are ignored; an empty table gives no
    rows. Equal shingles are told by 64-bit hashes.

    Texts stay where they are: shuffled are 2 bytes a shingle, 14 a shingle of a prefix, and the sets
    of those that can link: once into buckets, then only those of a comparison to their pivot. Tasks get bitmaps of 16 MB at most. Keys with many rows are dealt out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("row"))
    found = written(_found(rows, width, percent), "found")
    return name_components(found, similar_sets(rows, found, width, percent))


def name_components(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``found`` with the smallest doc_id of their set's component."""
    own = found.where("block is null").select("doc_id", "set", "n")
    per_set = own.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = written(_named(per_set, labels), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = written(join_hot(named, least, "label").select("set", "component_id"), "component-ids")
    linked = join_hot(own.where("n > 0"), ids, "set").select("doc_id", "n", "component_id")
    alone = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component of ``jaccard_components``: the
    one with the smallest doc_id, a null last; of equal ones that with the smallest hash.

    Rows whose texts have no words stay, but of rows that repeat both doc_id and text one. Which of
    those stays is settled by a hash of the other columns.

    The rows are told by a hash of 128 bits of doc_id and text; texts are shuffled once, by that hash, after
    each task has cut rows that repeat both down to one. Columns of any name stay as they are.
    """
    doc_id = F.col("doc_id").cast("long")
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), doc_id, "text")), 16, "0")
    key = F.unhex(F.concat(half(1), half(2)))
    rows = docs.select(doc_id.alias("doc_id"), "text", key.alias("row"))
    found = written(_found(rows, width, percent), "found")
    labels = similar_sets(rows, found, width, percent)
    own = found.where("block is null")
    per_set = own.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    stay = _named(per_set, labels).groupBy("label").agg(F.min("first")["row"].alias("__row")).select("__row")
    stay = written(stay.union(own.where("n = 0").select("row").distinct()), "stay")
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]
    order = F.xxhash64(*others) if others else F.lit(0)
    kept = docs.select(key.alias("__row"), order.alias("__order"), F.struct(*docs.columns).alias("__own")).join(stay, "__row", "left_semi")
    return kept.groupBy("__row").agg(F.min_by("__own", "__order").alias("__own")).select("__own.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
