"""Hidden Markov language model over hashed word classes."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import in_small_batches, join_hot, table, written

#: Word classes; class CLASSES is the end token's own.
CLASSES, STATES = 4096, 6
#: Words with the largest counts, this many at most, go to every task; longer words than this are told by a digest.
COMMON_WORDS, COMMON_BYTES = 250_000, 64
#: Documents are trained on in pieces of this many tokens, and scored by products over such pieces.
PIECE = 128
#: Sequences of up to this many tokens are scored side by side, longer ones in pieces, which takes STATES times the work.
LONG = 2048
#: Pieces, or sequences, that are worked on side by side (a step of so many stays in a cache), and tokens of such sequences.
ABREAST, ABREAST_TOKENS = 1000, 1 << 19
#: Baum-Welch rounds, each over all training documents.
ROUNDS = 14
FLUSH = 400_000


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased; bytes.split() splits on exactly the six ASCII spaces."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def known_as(words: list[bytes]) -> list[bytes]:
    """Words as they are counted: long ones by a digest, so that no key is longer than COMMON_BYTES."""
    if max(map(len, words), default=0) <= COMMON_BYTES:
        return words
    return [w if len(w) <= COMMON_BYTES else b"\0" + hashlib.blake2b(w, digest_size=24).digest() for w in words]


def word_class(word: bytes) -> int:
    return zlib.crc32(word) % CLASSES


def held_out_column():
    """crc32 of doc_id as text, modulo 7, is 2; a null doc_id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: the tokens of ``docs`` (text), without end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                seen.update(known_as(tokens(value.as_py())))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return in_small_batches(docs.select("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """start, between: distributions of the silent state before a text, and before a later piece."""

    def __init__(self, start, between, move, emit):
        self.start, self.between, self.move, self.emit = start, between, move, emit

    @staticmethod
    def seeded(shares: np.ndarray, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        emit = shares * r.uniform(0.5, 1.5, (STATES, len(shares)))
        move = np.full((STATES, STATES), 0.02) + np.eye(STATES) * 0.9
        even = np.full(STATES, 1 / STATES)
        return Model(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def counted(start, between, move, emit, shares: np.ndarray) -> Model:
        """Maximum-likelihood shares, smoothed: every class keeps some of its overall share."""
        emit = emit + 20.0 * shares
        parts = start + 0.1, between + 0.1, move + 0.1, emit
        return Model(*(p / p.sum(-1, keepdims=True) for p in parts))


def pieces_of(ids: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(ids), PIECE):
        yield ids[at : at + PIECE]


class Steps:
    """Sequences side by side, longest first: the classes of all first tokens, then of all second ones,
    and so on. ``order`` says which sequence is where; step t holds places ``at[t]`` to ``at[t + 1] - 1``."""

    def __init__(self, seqs: list[np.ndarray]):
        size = np.array([len(p) for p in seqs])
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        self.n, self.at = len(seqs), np.append(0, np.cumsum(live))
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.classes = np.empty(len(nth), np.int64)
        self.classes[self.at[nth] + np.repeat(np.arange(self.n), size)] = np.concatenate([seqs[i] for i in self.order])

    def emissions(self, model: Model) -> np.ndarray:
        out = np.empty((STATES, len(self.classes)))
        for e, to in zip(model.emit, out, strict=True):
            e.take(self.classes, out=to, mode="clip")
        return out


def expected_counts(model: Model, pieces: list[np.ndarray], firsts: np.ndarray):
    """One Baum-Welch pass over some pieces: counts of starts, moves and emissions by scaled forward and backward recursions."""
    steps = Steps(pieces)
    firsts, at = firsts[steps.order], steps.at.tolist()
    emit = steps.emissions(model)
    begin = np.where(firsts, model.start[:, None], model.between[:, None])
    alpha, scale = np.empty_like(emit), np.empty(emit.shape[1])
    onward = np.ascontiguousarray(model.move.T)
    before = begin
    for x, y in zip(at, at[1:], strict=False):
        a = onward @ before[:, : y - x]
        a *= emit[:, x:y]
        a.sum(0, out=scale[x:y])
        before = np.divide(a, scale[x:y], out=alpha[:, x:y])
    emit /= scale
    # Past its end a sequence's beta is 1. Alphas times betas take the place of alphas that are no longer needed.
    move, after = np.zeros((STATES, STATES)), np.ones((STATES, steps.n))
    for t in range(len(at) - 2, -1, -1):
        x, y = at[t], at[t + 1]
        alpha[:, x:y] *= after[:, : y - x]
        weighted = emit[:, x:y]
        weighted *= after[:, : y - x]
        before = begin if t == 0 else alpha[:, at[t - 1] : at[t - 1] + y - x]
        move += before @ weighted.T
        after[:, : y - x] = model.move @ weighted
    first = begin * after
    counts = np.stack([np.bincount(steps.classes, gamma, CLASSES + 1) for gamma in alpha])
    return first[:, firsts].sum(1), first[:, ~firsts].sum(1), model.move * move, counts, float(np.log(scale).sum())


def batched_counts(model: Model, rows: Iterator[np.ndarray], size: int = ABREAST):
    """Sums of ``expected_counts`` over documents, some pieces at a time."""
    total, pieces, firsts = [np.zeros(STATES), np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1)), 0.0], [], []

    def add():
        for i, x in enumerate(expected_counts(model, pieces, np.array(firsts))):
            total[i] = total[i] + x
        pieces.clear()
        firsts.clear()

    for ids in rows:
        for i, p in enumerate(pieces_of(ids)):
            pieces.append(p)
            firsts.append(i == 0)
            if len(pieces) >= size:
                add()
    if pieces:
        add()
    return total


def log_likelihoods(model: Model, docs: list[np.ndarray], size: int = ABREAST) -> np.ndarray:
    """Natural-log likelihood of each whole sequence of classes: the scaled forward recursion, run over
    the sequences side by side. Those above LONG are run in pieces from every state at once, whose
    matrices then multiply in order."""
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    for find, some in ((_short_likelihoods, [i for i in order if len(docs[i]) <= LONG]), (_long_likelihoods, [i for i in order if len(docs[i]) > LONG])):
        while some:
            # The longest is the last, so so many of its length are within the bound.
            n = max(1, min(size, ABREAST_TOKENS // len(docs[some[-1]])))
            some, part = some[:-n], some[-n:]
            out[part] = find(model, [docs[i] for i in part])
    return out


def _short_likelihoods(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    steps = Steps(docs)
    emit, logs = steps.emissions(model), np.zeros(steps.n)
    state, onward = np.repeat(model.start[:, None], steps.n, 1), np.ascontiguousarray(model.move.T)
    at = steps.at.tolist()
    for x, y in zip(at, at[1:], strict=False):
        a = onward @ state[:, : y - x]
        a *= emit[:, x:y]
        s = a.sum(0)
        state = np.divide(a, s, out=a)
        logs[: y - x] += np.log(s)
    out = np.empty(steps.n)
    out[steps.order] = logs
    return out


def _long_likelihoods(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    pieces = [list(pieces_of(d)) for d in docs]
    steps = Steps([p for ps in pieces for p in ps])
    mats, logs = np.repeat(np.eye(STATES)[None], steps.n, 0), np.zeros(steps.n)
    for x, y in zip(steps.at, steps.at[1:], strict=False):
        k = y - x
        m = (mats[:k].reshape(-1, STATES) @ model.move).reshape(k, STATES, STATES) * model.emit.T[steps.classes[x:y]][:, None, :]
        s = m.max((1, 2))
        mats[:k] = m / s[:, None, None]
        logs[:k] += np.log(s)
    place = np.empty(steps.n, np.int64)
    place[steps.order] = np.arange(steps.n)
    out, nth = np.zeros(len(docs)), iter(place)
    for i, ps in enumerate(pieces):
        state = model.start
        for k in (next(nth) for _ in ps):
            state = state @ mats[k]
            s = state.sum()
            state = state / s
            out[i] += logs[k] + np.log(s)
    return out


COUNT_DDL = ", ".join(["bucket int", *(f"s{j} double" for j in range(STATES))])


def _spread(start, between, move, counts, log) -> pa.RecordBatch:
    """Counts as rows: classes 0 to CLASSES, then starts, pieces' starts, moves and the log likelihood."""
    extra = np.zeros(STATES)
    extra[0] = log
    values = np.vstack([counts.T, start, between, move, extra])
    seen = np.flatnonzero(np.abs(values).sum(1) > 0)
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(values[seen, j]) for j in range(STATES))], ["bucket", *(f"s{j}" for j in range(STATES))])


def _gathered(rows, shares: np.ndarray) -> tuple[Model, float]:
    values = np.zeros((CLASSES + 1 + 2 + STATES + 1, STATES))
    for r in rows:
        values[r[0]] = r[1:]
    c = CLASSES + 1
    return Model.counted(values[c], values[c + 1], values[c + 2 : c + 2 + STATES], values[:c].T, shares), float(values[-1, 0])


def train(encoded: DataFrame, shares: np.ndarray) -> Model:
    """Baum-Welch over all rows of ``encoded`` (ids), from ``Model.seeded``: each round's counts are made by
    every task for its documents and summed over tasks; only the sums, some 4,100 rows, reach the driver."""
    model = Model.seeded(shares)
    for _ in range(ROUNDS):

        def count(batches, model=model):
            rows = (np.frombuffer(x.as_py(), "<u2").astype(np.int64) for b in batches for x in b.column(0))
            yield _spread(*batched_counts(model, rows))

        sums = encoded.select("ids").mapInArrow(count, COUNT_DDL).groupBy("bucket").agg(*(F.sum(f"s{j}") for j in range(STATES)))
        model, _ = _gathered(sums.collect(), shares)
    return model


def _common(vocab: DataFrame) -> list:
    """The words with the largest counts, by a bound on the count that leaves at most COMMON_WORDS."""
    sized = vocab.withColumn("size", F.floor(F.log2("c") * 8))
    left, bound = COMMON_WORDS, 1 << 20
    for size, n in sorted(map(tuple, sized.groupBy("size").count().collect()), reverse=True):
        if n > left:
            break
        left, bound = left - n, size
    return sized.where(F.col("size") >= bound).select("word", "c").collect()


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    The model learns from the rows that are not held out. A token's probability in a state is that
    of its class there times (c + 1) / (N + V + 1) over its class: c its training count, N and V
    the class's tokens and distinct words, 1 for unseen words, so all tokens' probabilities sum to
    one. The end token is a class of its own. The score is the log10 probability of the whole
    token sequence, exact by the forward recursion.

    A null or empty text is the end token alone. A null doc_id counts as empty text for the split.
    Repeated rows are scored, and counted, one by one. Extra columns are ignored; an empty table
    gives no rows; if all rows are held out, counts are 0 and all classes alike.

    Counts are summed before the shuffle. Common words' counts (bounded) go to every task, those of
    the rest are joined by word, frequent ones (in texts held out, say) apart.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out_column().alias("held_out"))
    training = rows.where(~F.col("held_out"))
    vocab = written(count_words(training).select("word", "c", (F.crc32("word") % CLASSES).cast("int").alias("class")), "lm-words")
    n_train = training.count()
    totals = vocab.groupBy("class").agg(F.sum("c"), F.count("*")).collect()
    class_n, class_v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for b, c, v in totals:
        class_n[b], class_v[b] = c, v
    class_n[CLASSES] = n_train
    total = int(class_n.sum())
    distinct = int(class_v.sum()) + (n_train > 0)
    shares = (class_n + 1) / (class_n + 1).sum()
    common = spark.sparkContext.broadcast({bytes(w): c for w, c in _common(vocab)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = list(common.value)
        place = {w: i for i, w in enumerate(words)}
        log_c = np.log10(np.array([common.value[w] for w in words], float) + 1)
        classes = np.array([word_class(w) for w in words], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, known, logs, ids, rare, times, ends = [], [], [], [], [], [], [0]
                for text in part.column("text").to_pylist():
                    ws = known_as(tokens(text))
                    pos = np.fromiter(map(place.get, ws, repeat(-1)), np.int64, len(ws))
                    lost = np.flatnonzero(pos < 0)
                    found = pos[pos >= 0]
                    own = np.full(len(ws) + 1, CLASSES, np.int64)
                    if len(found):
                        own[:-1] = classes[pos]
                    others = [ws[i] for i in lost.tolist()]
                    own[lost] = [word_class(w) for w in others]
                    n.append(len(ws) + 1)
                    known.append(len(found))
                    logs.append(float(log_c[found].sum()))
                    ids.append(own.astype("<u2").tobytes())
                    found_rare = Counter(others)
                    rare += found_rare.keys()
                    times += found_rare.values()
                    ends.append(len(rare))
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs), pa.array(ids, pa.binary())]
                each = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "known", "logs", "ids", "rare"])

    ddl = "doc_id long, held_out boolean, n_tokens long, known long, logs double, ids binary, rare array<struct<word:binary,n:long>>"
    encoded = written(in_small_batches(rows.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(encode, ddl).withColumn("row_id", F.monotonically_increasing_id()), "lm-encoded")
    model = train(encoded.where(~F.col("held_out")), shares)
    # log10 of each class's divisor, and of the base's.
    divisor = np.log10(class_n + class_v + 1)
    divisor[CLASSES] = 0.0
    base_divisor = float(np.log10(total + distinct + 1))
    end = float(np.log10(n_train + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                seqs = [np.frombuffer(x, "<u2").astype(np.int64) for x in part.column("ids").to_pylist()]
                like = log_likelihoods(model, seqs) / np.log(10)
                within = np.array([divisor[s].sum() for s in seqs])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_id", "doc_id", "held_out", "n_tokens", "known", "logs")), pa.array(like - within)], ["row_id", "doc_id", "held_out", "n_tokens", "known", "logs", "sequence"])

    scored = encoded.select("row_id", "doc_id", "held_out", "n_tokens", "known", "logs", "ids").mapInArrow(
        score, "row_id long, doc_id long, held_out boolean, n_tokens long, known long, logs double, sequence double"
    )
    pairs = encoded.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.n")
    extra = join_hot(pairs, vocab.select("word", "c"), "word").groupBy("row_id").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = scored.join(extra, "row_id", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    seen_end = int(n_train > 0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + seen_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * base_divisor).alias("base_score"),
        (logs + F.col("sequence")).alias("score"),
    )


def op9_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
