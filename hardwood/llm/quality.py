"""Quality rules by hashed n-gram likelihood ratio, and a weak-label quality classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import in_small_batches, table, words_of, written

# ---------------------------------------------------------------------------------------------
# Counts of one text

# Fixed value: the symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
#: A symbol, or a mark that ends a sentence, at the end of a word.
SYMBOL_END = re.compile(r"[#*$%&|<>](?![^\x20\x09-\x0D])")
SENTENCE_END = re.compile(r"[.!?](?![^\x20\x09-\x0D])")
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(words) <= width:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    window = ids[: len(ids) - width + 1].copy()
    for k in range(1, width):
        # Renumbered at each step, so that the products stay small whatever the text's length.
        _, window = np.unique(window * (len(seen) + 1) + ids[k : len(ids) - width + 1 + k], return_inverse=True)
    often = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            n += line in seen
            seen.add(line)
    return n


def capital_share(text: str) -> float:
    """Capitals among a text's letters, Latin ones told apart; 0 without letters."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    capitals = int((((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))).sum())
    letters = capitals + int((((c >= 97) & (c <= 122)) | ((c >= 0xDF) & (c != 0xF7))).sum())
    return capitals / letters if letters else 0.0


def text_counts(text: str | None) -> dict[str, int]:
    words = words_of(text)
    text = text or ""
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicate_lines(text) if "\n" in text else 0,
        "n_repeat_words": repeated_words(words),
    }


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def ngram_buckets(text: str | None) -> np.ndarray:
    """Hashed bucket of each 4-gram of the text's UTF-8 bytes, with a space at both ends."""
    raw = np.frombuffer(f" {text or ''}  ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    gram = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    return ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


# ---------------------------------------------------------------------------------------------
# Quality rules: log-likelihood ratio of trusted target to raw corpus

COUNT_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: A document whose mean log-likelihood ratio per n-gram is below this goes.
RATIO_THRESHOLD = -0.25


def trusted(text: str | None, c: dict[str, int]) -> bool:
    """Whether a document belongs to the trusted target: plain running text by strict rules."""
    if base_failed(c):
        return False
    n = c["n_words"]
    return (
        c["n_symbols"] * 100 <= n
        and c["n_dup_lines"] == 0
        and c["n_repeat_words"] * 10 <= n
        and capital_share(text) <= 0.2
        and text.count("!") * 20 <= n
        and 2 * n <= c["word_chars"] <= 15 * n
    )


def ratio_weights(docs: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio of each bucket, counted over all documents.

    Each task sends a row for each of its buckets, 2**14 at most; the sums, as many, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if text:
                    n = np.bincount(ngram_buckets(text), minlength=BUCKETS)
                    raw += n
                    if trusted(text, text_counts(text)):
                        target += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    sums = in_small_batches(docs.select("text")).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in sums:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: np.log((x + smoothing) / (x.sum() + smoothing * BUCKETS))
    return share(target) - share(raw)


def ratio_score(weights: np.ndarray, text: str | None) -> float:
    """Mean log-likelihood ratio of the text's n-grams; 0 without text."""
    return float(weights[ngram_buckets(text)].mean()) if text else 0.0


def with_columns(docs: DataFrame, make, types: str, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns that ``make`` gives for each text as a dict; ``docs`` columns of these names are replaced."""
    new = [x.split()[0] for x in types.split(", ")]
    keep = [c for c in (columns or docs.columns) if c not in new]
    has_text = "text" in keep
    source = docs.select(*[docs[c] for c in keep], *([] if has_text else [docs["text"]]))
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    kinds = [arrow[x.split()[1]] for x in types.split(", ")]
    place = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(v.as_py()) for v in batch.column(place)]
            made = [pa.array([r[n] for r in rows], k) for n, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made], [*keep, *new])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]), types])
    return in_small_batches(source).mapInArrow(run, ddl)


def apply_quality_rules(docs: DataFrame, threshold: float = RATIO_THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with the base counts, base_failed, score and kept.

    The trusted target is the documents that strict rules call plain running text; the raw corpus
    is all of them. A document's score is the mean, over its hashed byte 4-grams, of the logarithm
    of its bucket's share in the target over that in the corpus. It is kept if the base rules hold
    and the score is at least ``threshold``: the same for every document, at any size.

    A null or empty text has no words and fails the base. Repeated rows get the same verdict.
    Without any trusted document all scores are 0. Extra columns are kept unless named like a new
    one; an empty table gives no rows. Nothing but bucket counts is shuffled.
    """
    weights = ratio_weights(docs)

    def judge(text: str | None) -> dict:
        c = text_counts(text)
        failed, score = base_failed(c), ratio_score(weights, text)
        return c | {"base_failed": failed, "score": score, "kept": not failed and score >= threshold}

    return with_columns(docs, judge, f"{COUNT_TYPES}, base_failed boolean, score double, kept boolean", columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(table(spark, sf_dir, "documents"), columns=["doc_id"])


# ---------------------------------------------------------------------------------------------
# Quality classifier: weak labels

#: Votes: 2 good, 1 bad, 0 none.
GOOD, BAD, NO_VOTE = 2, 1, 0
#: The scorer is trained on about this many different documents, those whose hashes are smallest, and twice as many at most.
TRAIN_DOCS = 2_000
#: Assumed beforehand: a labeller's rates of bad votes on bad and on good documents, the share of good
#: documents, and how much that weighs, as a share of all documents.
RATES, GOOD_SHARE, WEIGHT = (0.3, 0.002), 0.85, 0.005


def _vote(value: float, good: float, bad: float) -> int:
    return GOOD if value <= good else BAD if value >= bad else NO_VOTE


def vote_symbols(text, words, c):
    """Symbols a word."""
    return _vote(c["n_symbols"] / len(words), 0.05, 0.3)


def vote_symbol_words(text, words, c):
    """Share of words that end in a symbol."""
    return _vote(len(SYMBOL_END.findall(text)) / len(words), 0.03, 0.2)


def vote_capitals(text, words, c):
    """Share of capital letters."""
    return _vote(capital_share(text), 0.2, 0.5) if len(words) >= 5 else NO_VOTE


def vote_shouting(text, words, c):
    """Exclamation marks a word."""
    return _vote(text.count("!") / len(words), 0.1, 0.5)


def vote_repeats(text, words, c):
    """Share of words in repeated three-word windows."""
    return _vote(c["n_repeat_words"] / len(words), 0.25, 0.6) if len(words) >= 10 else NO_VOTE


def vote_lines(text, words, c):
    """Share of lines that repeat an earlier one."""
    lines = text.count("\n") + 1
    return _vote(c["n_dup_lines"] / lines, 0.1, 0.4) if lines >= 3 else NO_VOTE


def vote_sentences(text, words, c):
    """Whether sentences end, in texts long enough to tell."""
    return _vote(-len(SENTENCE_END.findall(text)) / len(words), -0.01, -0.001) if len(words) >= 60 else NO_VOTE


def vote_lengths(text, words, c):
    """Mean word length."""
    mean = c["word_chars"] / len(words)
    return GOOD if 3 <= mean <= 11 else BAD if mean < 1.5 or mean > 25 else NO_VOTE


LABELLERS = (vote_symbols, vote_symbol_words, vote_capitals, vote_shouting, vote_repeats, vote_lines, vote_sentences, vote_lengths)


def vote_pattern(text: str | None) -> int:
    """All labellers' votes as a number in base 3; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    c, pattern = text_counts(text), 0
    for labeller in LABELLERS:
        pattern = 3 * pattern + labeller(text, words, c)
    return pattern


def pattern_votes(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def fit_label_model(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray, float]:
    """Expectation-maximisation over vote patterns and their numbers of documents.

    A labeller that votes is right about good documents with one probability and about bad ones
    with another; not voting says nothing. The rates, and the share of good documents, are the
    expected counts with a weak prior (``RATES``, ``GOOD_SHARE``, worth ``WEIGHT`` of all documents) that
    tells the two classes apart. A labeller with many false alarms so loses its weight. Returns each
    pattern's probability of being good, the labellers' rates of bad votes (labeller; on bad, on good
    documents) and the share of good documents.
    """
    k = len(LABELLERS)
    patterns = sorted(counts)
    votes = np.array([pattern_votes(p) for p in patterns]).reshape(-1, k)
    n = np.array([counts[p] for p in patterns], float)
    bad_vote, good_vote = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    prior, weight = np.array(RATES), WEIGHT * n.sum()
    rates, good, post = np.tile(prior, (k, 1)), GOOD_SHARE, np.zeros(len(patterns))
    for _ in range(rounds if len(patterns) else 0):
        like = bad_vote @ np.log(rates) + good_vote @ np.log(1 - rates) + np.log([1 - good, good])
        post = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -500, 500)))
        mass = np.stack([n * (1 - post), n * post], 1)
        said, voted = bad_vote.T @ mass, (bad_vote + good_vote).T @ mass
        rates = (said + weight * prior) / (voted + weight)
        good = float((mass[:, 1].sum() + weight * GOOD_SHARE) / (n.sum() + weight))
    return dict(zip(patterns, post.tolist(), strict=True)), rates, good


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's 4-grams and their values: square roots of the counts, of length 1."""
    counts = np.bincount(ngram_buckets(text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / math.sqrt(float((value**2).sum()))


def train_scorer(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 80, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on ``hashed_features`` against probabilities; the last weight is the bias."""
    row = np.repeat(np.arange(len(features)), [len(at) for at, _ in features])
    col, value = (np.concatenate([f[i] for f in features]) for i in range(2))
    w, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    # Both classes weigh the same.
    weight = labels / max(labels.sum(), 1e-9) + (1 - labels) / max((1 - labels).sum(), 1e-9)
    weight *= 1 / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[col], len(features)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = np.append(np.bincount(col, value * d[row], BUCKETS), d.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def scorer_probability(w: np.ndarray, text: str | None) -> float:
    at, value = hashed_features(text)
    return float(1 / (1 + np.exp(-np.clip((w[at] * value).sum() + w[-1], -30, 30))))


def classify_quality(docs: DataFrame, threshold: float = 0.1, train_docs: int = TRAIN_DOCS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with quality_votes (pattern), quality_label (posterior), quality_score and quality_kept.

    Eight heuristic labellers vote good, bad or not at all on every document. Expectation-
    maximisation over the vote patterns of all documents estimates how often each labeller is
    right; its posteriors label about ``train_docs`` different documents, those with the smallest
    hashes, on which a hashed linear scorer is trained. The scorer judges every document: kept if
    its probability of being good is at least ``threshold`` (low: only clear cases go).

    A null or empty text gets no votes, the prior as label, and is scored by the bias and the end
    marks alone. Repeated rows get the same score and train the scorer once. With no documents to
    train on, all are kept. Extra columns are kept unless named like a new one; an empty table gives
    no rows.

    3**8 pattern counts at most, and the sample's features, 2 * ``train_docs`` rows of 2**14 numbers at
    most, are gathered in one place; its texts are not.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vote_pattern(v.as_py()) for v in batch.column(0)], pa.int32())], ["pattern"])

    counts = {r[0]: r[1] for r in in_small_batches(docs.select("text")).mapInArrow(vote, "pattern int").groupBy("pattern").count().collect()}
    posteriors, _, _ = fit_label_model(counts)
    n = sum(counts.values())
    # Hashes below this bound: about train_docs rows, of any input.
    bound = -(1 << 63) + (1 << 64) * min(1.0, train_docs / max(n, 1))
    sample = rows.where(F.col("h").cast("double") <= F.lit(float(bound)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if h not in seen and len(seen) < 4 * train_docs:
                    seen.add(h)
                    at, value = hashed_features(text.as_py())
                    out.append((h, posteriors.get(vote_pattern(text.as_py()), 0.5), at.astype("<i4").tobytes(), value.astype("<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.binary(), pa.binary()))], ["h", "label", "at", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({r["h"]: (r["label"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f8")) for batch in batches for r in batch.to_pylist()}.items(), key=lambda r: r[0])[: 2 * train_docs]
        labels = np.array([r[0] for _, r in got])
        w = train_scorer([r[1:] for _, r in got], labels) if got and 0 < labels.sum() < len(labels) else np.append(np.zeros(BUCKETS), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    picked = written(in_small_batches(sample).mapInArrow(features, "h long, label double, at binary, value binary"), "quality-train").coalesce(1)
    fitted = picked.mapInArrow(fit, "w binary").collect() if n else []
    weights = np.frombuffer(fitted[0][0]) if fitted else np.append(np.zeros(BUCKETS), 1.0)

    def judge(text: str | None) -> dict:
        pattern = vote_pattern(text)
        score = scorer_probability(weights, text)
        return {"quality_votes": pattern, "quality_label": posteriors.get(pattern, 0.5), "quality_score": score, "quality_kept": score >= threshold}

    return with_columns(docs, judge, "quality_votes int, quality_label double, quality_score double, quality_kept boolean", columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", F.col("quality_votes").alias("votes"), F.col("quality_label").alias("label"), F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


