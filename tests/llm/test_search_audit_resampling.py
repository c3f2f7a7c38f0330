"""Exact search, the filter audit and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.llm import audit, importance, topk

R = random.Random(11)
NAN, INF = float("nan"), float("inf")


# --- exact search ---------------------------------------------------------------------------


def searched(rows, every=5, top=3):
    """The rows (vec_id, vector) as the docstring says, by plain loops."""
    ok = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % every == 0:
            near = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j, m) for m, j, v in ok if m != n), key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
            out += [(i, k + 1, r[2], max(-(1 << 63), min((1 << 63) - 1, -r[0]))) for k, r in enumerate(near[:top])]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, row long, score string"


def top_rows(spark, rows, every=5, top=3):
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS).coalesce(1)
    got = topk.exact_top_k(df, F.col("vec_id") % every == 0, top)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_search_by_plain_products(spark, monkeypatch):
    rows = [(i, [R.uniform(-1, 1) if R.random() < 0.6 else 0.0 for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 12) for i in range(40)]  # ties among copies
    rows = [(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in rows]
    assert top_rows(spark, rows) == searched(rows)
    monkeypatch.setattr(topk, "CELL_VALUES", 500)  # many cells of candidates and blocks of queries
    assert top_rows(spark, rows) == searched(rows)


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [NAN, 1.0]), (20, [INF, 1.0]), (25, []), (30, [0.25, -0.5, 8.0]), (None, [4.0, 4.0]), (None, [4.0, 4.0])]
    rows += [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [0.0, 0.0]), (40, [2.0**100, -(2.0**100)]), (41, [2.0**100, 1.0])]
    assert top_rows(spark, rows, top=4) == searched_clipped(rows, 4)
    assert top_rows(spark, [(5, [1.0])]) == [] and top_rows(spark, []) == []


def searched_clipped(rows, top):
    """As ``searched``, with components clipped to 64 bits."""
    least, most = -(1 << 63), (1 << 63) - 1
    ok = [(n, i, [max(least, min(most, math.floor(1024 * x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 5 == 0:
            score = lambda v, q=q: max(least, min(most, sum(a * b for a, b in zip(q, v))))
            near = sorted(((-score(v), j is None, j or 0, m, j) for m, j, v in ok if m != n))
            out += [(i, k + 1, r[4], -r[0]) for k, r in enumerate(near[:top])]
    return sorted(out, key=str)


def test_search_with_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_VALUES", 64)
    rows = [(i, [1.0, 0.5]) for i in range(200)] + [(200 + i, [0.1 * i, 0.0]) for i in range(20)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert top_rows(spark, rows, 50, 10) == searched(rows, 50, 10)


# --- filter audit ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(docs, labels):
    fails, least = [], {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, s in docs:
        text = t or ""
        w = WORD.findall(text)
        caps = len(re.findall("[A-Z]", text))
        last = text in least and (i is None or least[text] < i)
        marks = [m for m in labels if m[0] is not None and m[0] == i]
        fails.append((s or "", {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * caps > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": last}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = []
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        gone, table = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                stay = [r for r in left if not r[1][f]]
                table.append([part, order, step, len(stay), len(here), sum(r[1][f] for r in rows) - len(here), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), f])
                gone[f] += len(here)
                left = stay
        out += [tuple(r[:9]) + (gone[r[9]],) for r in table]
    return sorted(out)


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, part string, flags int")
    m = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int, first int")
    return sorted(map(tuple, audit.audit_filters(d, m).collect()))


def sample_docs():
    out = []
    for i in range(120):
        words = [R.choice(["alpha", "beta", "Gamma", "DELTA", "eps$", "zeta"]) if R.random() < 0.5 else f"w{R.randrange(400)}" for _ in range(R.choice([3, 150, 260]))]
        out.append((i, " ".join(words), R.choice(["a", "b", "c"])))
    out += [(200 + i, out[i % 7][1], "a") for i in range(30)]
    return out


def test_audit_by_plain_filters(spark):
    docs = sample_docs()
    labels = [(i, R.choice([0, 1, None]), R.choice([0, 1, None])) for i in range(0, 240, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    assert audit_rows(spark, docs, labels) == audited(docs, labels)


def test_audit_of_odd_rows(spark):
    docs = [(1, None, None), (2, "", ""), (3, "  \n", "s"), (None, None, "s"), (None, "x " * 300, None), (7, "x " * 300, "s"), (7, "x " * 300, "s"), (8, "É Ü ÀB" * 90, "s"), (9, "x" * 3_000_000 + " y", "long")]
    assert audit_rows(spark, docs, [(7, 1, 0)]) == audited(docs, [(7, 1, 0)])
    assert audit_rows(spark, [], []) == []
    assert len(audit_rows(spark, [(1, "a", "s")], [])) == 600


def test_audit_with_one_very_common_text_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 3)
    docs = [(i, "the same text", f"p{i % 9}") for i in range(2500)]
    assert audit_rows(spark, docs, []) == audited(docs, [])


def test_words_of_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(audit, "SLICE", 16)
    monkeypatch.setattr(importance, "SLICE", 16)
    for _ in range(200):
        text = "".join(R.choice("ab \n\té") for _ in range(R.randrange(120)))
        w = WORD.findall(text)
        assert audit.word_counts(text.encode()) == (len(w), len(set(w)))
        assert counted(text) == plain_features(text)


# --- importance resampling ------------------------------------------------------------------

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = FEATURE_WORD.findall((text or "").translate(LOW))
    return len(w), Counter(zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def counted(text):
    at, n, words = importance.feature_counts(text.encode())
    return words, Counter(dict(zip(at.tolist(), n.tolist())))


def resampled(docs, target):
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = sum((r[2] for r in rows), Counter()), sum((plain_features(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, f in rows:
        k = sum(f.values())
        weight = sum(c * gain(b) for b, c in f.items()) // k if k else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, k, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], r[1]))
    for place, r in enumerate(able):
        r[4] = place + 1 if place < 25 * len(able) // 100 else None
    return sorted((tuple(r[:4]) + (r[4] if r in able else None,) for r in out), key=str)


def resample_rows(spark, docs, target):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, weight string")
    t = spark.createDataFrame([(i, x, 0) for i, x in enumerate(target)], "item_id long, text string, doc_id int")
    return sorted(map(tuple, importance.resample(d, t).collect()), key=str)


def test_resampling_by_plain_counts(spark):
    words = [f"w{i}" for i in range(300)] + ["Straße", "naïve", "x1"]
    docs = [(i, " ".join(R.choice(words[: 20 + i]) for _ in range(R.randrange(60)))) for i in range(250)]
    target = [" ".join(words[:15]), " ".join(words[5:25] * 3)]
    assert resample_rows(spark, docs, target) == resampled(docs, target)


def test_resampling_of_odd_rows(spark):
    text = "One two, three-four five. " * 6
    docs = [(1, None), (2, ""), (3, "... --- \x00"), (None, text), (None, text), (4, text), (4, text), (5, "é" * 50), (6, "a b " * 200_000), (7, "word " * 19)]
    assert resample_rows(spark, docs, [text, None, ""]) == resampled(docs, [text, None, ""])
    assert resample_rows(spark, [], [text]) == []
    assert resample_rows(spark, docs, []) == resampled(docs, [])


def test_resampling_in_many_blocks(spark, monkeypatch):
    """Blocks end anywhere, and counts take one, two or four bytes of theirs."""
    words = [f"w{i}" for i in range(60)]
    docs = [(i, R.choice([None, "", " ".join(R.choice(words) for _ in range(R.randrange(80))), "one two " * 300])) for i in range(150)]
    docs.insert(70, (150, "a " * 70_000))
    monkeypatch.setattr(importance, "BLOCK", 150)
    assert resample_rows(spark, docs, [" ".join(words[:30])]) == resampled(docs, [" ".join(words[:30])])
    blocks = importance.count_blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert len(blocks) > 10 and {b.width for b in blocks} == {1, 2, 4}
    assert [i for b in blocks for i in b.doc_ids] == [i for i, _ in docs]


@pytest.mark.parametrize("buckets", [10, 100_000])
def test_blocks_keep_counts(spark, buckets):
    docs = [(i, "x y z " * i) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    sums = importance.column_sums(importance.count_blocks(d, buckets), buckets)
    assert sums.sum() == sum(max(6 * i - 1, 0) for i in range(300))
