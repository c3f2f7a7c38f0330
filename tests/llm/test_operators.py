"""Each operator against a brute-force version, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.llm import fingerprints, hmm, jaccard, mixing, pieces, quality, sharding, urls, warc
from hardwood.llm.common import new_folder
from tests.conftest import SF

R = random.Random(5)
WORDS = ["".join(R.choice("aeiourstln") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def changed(text, k):
    ws = text.split(" ")
    for i in range(0, len(ws), k):
        ws[i] = "other"
    return " ".join(ws)


BASE = [prose(120) for _ in range(12)]
ROWS = [(i, t, f"s{i % 4}") for i, t in enumerate(BASE)]
ROWS += [(100 + i, changed(BASE[i % 3], 60 - i), "s0") for i in range(12)]
ROWS += [(200, BASE[4], None), (201, None, "s1"), (202, "", "s1"), (203, "  \n ", "s2"), (204, "one two", "s2"), (205, "one two", "s3"), (None, BASE[5], "s3"), (206, "x" * 30000, "s1")]
ROWS += [(207, BASE[6], "s1"), (207, BASE[6], "s1"), (208, "THE!! BIG!! SALE!! " * 30, "s1"), (209, "a$$$ b%%% c&&& " * 30, "s0")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("own") for c in ("size", "shard", "kept", "set", "cell", "lang")}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, shards=3).toPandas()
    assert len(out) == len(ROWS) and not len(sharding.shard_documents(none).toPandas())
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 16 for _, t, _ in ROWS)
    assert sorted(out.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in ROWS)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_bounded_loads_and_movement():
    loads = {c: R.randint(1, 1000) for c in range(0, 1 << 16, 7)}
    at = {}
    for shards in (40, 41):
        parts = sharding.place_cells(loads, shards, 100, 0.02)
        held, ends = Counter(), {}
        for cell, _, start, shard in parts:
            ends.setdefault(cell, []).append((start, shard))
        for cell, p in ends.items():
            for (a, s), b in zip(p, [x for x, _ in p[1:]] + [loads[cell]], strict=True):
                held[s] += b - a
        assert sum(held.values()) == sum(loads.values()) and max(held.values()) <= math.ceil(sum(loads.values()) * 1.02 / shards)
        at[shards] = {c: p[0][1] for c, p in ends.items()}
    assert sum(at[40][c] != at[41][c] for c in loads) < 0.35 * len(loads)


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).toPandas()
    assert len(out) == len(ROWS) and not len(mixing.mix_sources(none).toPandas())
    per = out.drop_duplicates("source")
    assert abs(per.mix_target.sum() - out.mix_size.sum()) < 1e-6
    assert (out.mix_copies <= 3).all() and (out.mix_target <= 3 * out.mix_source_size + 1e-9).all()
    again = mixing.emit_mixture(docs)
    assert again.columns == docs.columns and again.count() == out.mix_copies.sum()


def test_urls(spark):
    rows = [(i, f"https://{h}.example.{t}/{p}/{i}") for i, (h, t, p) in enumerate((R.choice(["www", "a", "b"]), R.choice(["com", "net", "org"]), R.choice(["en", "es", "de"])) for _ in range(200))]
    rows += [(900, None), (901, "no scheme"), (902, "http://EXAMPLE.com"), (None, rows[0][1]), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("own"))
    out = urls.judge_urls(pages).toPandas()
    assert len(out) == len(rows) and set(out.verdict) == {"allow", "block"} and not len(urls.judge_urls(pages.where("false")).toPandas())
    for i, u in rows[:200]:
        got = out[out.page_id == i].iloc[0]
        host, path = u.split("/")[2], "/" + u.split("/", 3)[3]
        fits = [(len(n + p), n + p, v) for v, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
        assert (got.host, got.path, got["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert not fits or got.verdict == max(fits)[2]


def test_pieces_match_the_library(docs, none):
    import sentencepiece

    model = pieces.default_model()
    sp, mine = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Encoder(model)
    texts = [t for _, t, _ in ROWS] + ["\x00 ▁▁ a", " " * 70, "é日本𝄞\t\n", "aaaa" * 50, "<s> <0x41>"]
    texts += ["".join(chr(R.choice([R.randint(32, 126), R.randint(160, 0x2FFF), 32, 0x2581])) for _ in range(40)) for _ in range(200)]
    for t, ids in zip(texts, mine.encode(texts), strict=True):
        want = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and mine.model.decode(ids) == sp.decode(want)
    assert pieces.digest_documents(docs, model).count() == len(ROWS) and pieces.encode_documents(none, model).count() == 0


def brute_components(rows, width=5, percent=75):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


def test_jaccard(docs):
    got = jaccard.jaccard_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(ROWS)


@pytest.mark.parametrize("n", [0, 1, 100, 20_000, 200_000])
def test_flags_by_sorting_are_those_of_counters(n):
    g, top = np.random.default_rng(n), 1 << jaccard.COUNTER_BITS
    for values in (g.integers(0, top, n), (g.pareto(0.6, n) * 50).astype(np.int64) % top, g.integers(0, 4000, n) * 257 % top):
        want = jaccard._flags_by_counters(np.bincount(values, minlength=top))
        assert jaccard._flags_by_sorting(values) == want


def test_bitmap_is_the_same_by_sorting_and_by_counters(spark, monkeypatch):
    rows = [(i, " ".join(WORDS[:20] + [f"own{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = []
    for few, run in ((jaccard.FEW, jaccard.RUN_SHINGLES), (0, jaccard.RUN_SHINGLES), (0, 20)):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "RUN_SHINGLES", run)
        out.append(jaccard._frequent(docs, 1))
    assert [n for _, n in out] == [30 * len({*WORDS[:20]}) + 30] * 3
    assert np.unpackbits(out[0][0]).sum() == len({*WORDS[:20]})
    assert (out[0][0] == out[1][0]).all() and (out[0][0] == out[2][0]).all()


def test_jaccard_in_chunks(spark, monkeypatch):
    """Groups of copies about the threshold, in chunks so small that each group takes several."""
    rows = [(i, t, "s0") for i, t in enumerate(prose(90) for _ in range(4))]
    for i in range(160):
        ws = rows[i % 4][1].split(" ")
        for k in R.sample(range(90), R.randint(1, 6)):
            ws[k] = R.choice(WORDS)
        rows.append((100 + i, " ".join(ws), "s0"))
    monkeypatch.setattr(jaccard, "CHUNK", 700)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_shingles_of_texts_together():
    texts = [None, "", " \t\n", "one", "One TWO", "a b c d e", "a b c d e f", "x" * 5000, "\u00c9t\u00e9 \u00a0 b c d\x0be", *BASE]
    got = list(jaccard.shingle_sets(texts))
    for t, s in zip(texts, got, strict=True):
        assert (s == jaccard.shingles(t)).all() and len(s) == len(jaccard.shingles(t))
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(s) == (len({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}) if ws else 0)
    assert (jaccard.shingles("One two") == jaccard.shingles("one  TWO")).all()


def test_jaccard_empty(none):
    assert jaccard.jaccard_components(none).count() == 0


def test_quality_rules(docs, none):
    out = quality.apply_quality_rules(docs, columns=["doc_id"]).toPandas()
    assert len(out) == len(ROWS) and quality.apply_quality_rules(none).count() == 0
    for i, t, _ in ROWS:
        ws = (t or "").split()
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        covered = {k + d for k in range(len(ws) - 2) if grams[tuple(ws[k : k + 3])] > 1 for d in range(3)}
        got = quality.text_counts(t)
        assert got["n_repeat_words"] == len(covered) and got["n_words"] == len(ws)
    kept = dict(zip(out.doc_id, out.kept, strict=True))
    assert all(kept[i] for i in range(12)) and not any(kept[i] for i in (201, 202, 204, 208, 209))


def test_quality_classifier(docs, none):
    out = quality.classify_quality(docs).toPandas()
    assert len(out) == len(ROWS) and quality.classify_quality(none).count() == 0
    assert list(out.kept) == ["own"] * len(ROWS)
    kept = dict(zip(out.doc_id, out.quality_kept, strict=True))
    assert all(kept[i] for i in range(12))


def test_label_model_prefers_evidence():
    k = len(quality.LABELLERS)
    clean = int("2" * k, 3)
    shouting = int("22112222"[:k], 3)
    post, rates, good = quality.fit_label_model({clean: 900, shouting: 100})
    assert post[clean] > 0.9 and post[shouting] < 0.5 and 0.5 <= good <= 0.98 and (rates[:, 1] <= 0.005).all()


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/", "<p>same</p>"), (1, "http://b/\nx", "<p>same</p>"), (2, None, None), (4, "http://c/", ""), (None, "u", "<p>same</p>"), (5, "http://d/", "é" * 300000), (1, "http://b/", "<p>same</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("own"))
    files = warc.write_warc(pages, new_folder(spark, "warc-test"))
    for split in (50, 4 << 20):
        got = warc.read_warc(files, split).collect()
        assert Counter((r.page_id, bytes(r.payload) if r.record_type == "response" else None, r.record_type, r.refers_to) for r in got) == Counter(
            [(1, b"<p>same</p>", "response", None)] * 2 + [(3, None, "revisit", 1), (None, None, "revisit", 1), (2, b"", "response", None), (4, None, "revisit", 2), (5, ("é" * 300000).encode(), "response", None)]
        )
        for r in got:
            text = "" if r.page_id in (2, 4) else "é" * 300000 if r.page_id == 5 else "<p>same</p>"
            assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), base64.b32encode(hashlib.sha1(text.encode()).digest()).decode())
    large = warc.read_warc(warc.write_warc(pages, new_folder(spark, "warc-test"), min_bytes=5)).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in large} == {3, None}
    assert warc.read_warc(warc.write_warc(pages.where("false"), new_folder(spark, "warc-test"))).count() == 0


def test_fingerprints(docs, none, spark):
    assert fingerprints.fingerprint_documents(none).count() == 0
    assert fingerprints.fingerprint_documents(docs).count() == len(ROWS)
    rows = sorted(({r[0]: r for r in ROWS if r[0] is not None}).values(), key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        want = fingerprints.edited(t, after)
        assert len(want) <= len(t) and got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[i].near_next == fingerprints.likeness(fingerprints.signature(t), fingerprints.signature(after))
    assert got[4].fingerprint == got[200].fingerprint


def test_language_model(docs, none):
    assert hmm.score_documents(none).count() == 0
    out = hmm.score_documents(docs).collect()
    split = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = {(i, t): (t or "").encode().lower().split() + [None] for i, t, _ in ROWS}
    counts = Counter(w for i, t, _ in ROWS if not split(i) for w in toks[i, t])
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, split(i), len(toks[i, t]), sum(counts[w] > 0 for w in toks[i, t]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks[i, t]), 6)) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want


def test_forward_recursion_is_exact():
    r = np.random.default_rng(3)
    model = hmm.Model.seeded(r.dirichlet(np.ones(hmm.CLASSES + 1)))
    seqs = [r.integers(0, hmm.CLASSES, n) for n in (1, 5, 300, 1000)]
    for s, got in zip(seqs, hmm.log_likelihoods(model, seqs), strict=True):
        state, total = model.start, 0.0
        for x in s:
            state = (state @ model.move) * model.emit[:, x]
            total += math.log(state.sum())
            state = state / state.sum()
        assert abs(total - got) < 1e-8 * abs(total)


def test_training_sees_all_documents_in_every_round(spark):
    """More documents than a sample of 2,000 would hold, in which every tenth is of another kind."""
    r = np.random.default_rng(5)
    docs = [r.integers(0, 40, 6) + (400 if i % 10 == 0 else 0) for i in range(3000)]
    counts = np.bincount(np.concatenate(docs), minlength=hmm.CLASSES + 1)
    shares = (counts + 1) / (counts + 1).sum()
    encoded = spark.createDataFrame([(i, bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)], "row_id long, ids binary").repartition(3)
    got, want = hmm.train(encoded, shares), hmm.Model.seeded(shares)
    for _ in range(14):
        want = hmm.Model.counted(*hmm.batched_counts(want, iter(docs))[:4], shares)
    for part in ("start", "between", "move", "emit"):
        assert np.allclose(getattr(got, part), getattr(want, part), rtol=1e-6, atol=1e-9), part


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
    kept = corpus_pipeline.near_duplicates(spark, rows, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    want = {c for _, _, c in brute_components(ROWS)}
    assert sorted(ids) == sorted(want) and kept.columns == rows.columns


def test_expected_counts_by_plain_recursion():
    """Baum-Welch counts of some pieces against the sums over all paths' probabilities, state by state."""
    r = np.random.default_rng(7)
    model = hmm.Model.seeded(r.dirichlet(np.ones(hmm.CLASSES + 1)))
    pieces, firsts = [r.integers(0, 50, n) for n in (4, 1, 7, 4)], np.array([True, False, True, False])
    start, between, move, emit, total = hmm.expected_counts(model, pieces, firsts)
    want = [np.zeros_like(x) for x in (start, between, move, emit)]
    like = 0.0
    for p, first in zip(pieces, firsts, strict=True):
        forward = [model.start if first else model.between]
        for x in p:
            forward.append((forward[-1] @ model.move) * model.emit[:, x])
        back = [np.ones(hmm.STATES)]
        for x in p[::-1]:
            back.append(model.move @ (model.emit[:, x] * back[-1]))
        back, whole = back[::-1], forward[-1].sum()
        like += math.log(whole)
        want[0 if first else 1] += forward[0] * back[0] / whole
        for t, x in enumerate(p):
            want[2] += forward[t][:, None] * model.move * (model.emit[:, x] * back[t + 1])[None, :] / whole
            want[3][:, x] += forward[t + 1] * back[t + 1] / whole
    assert all(np.allclose(a, b) for a, b in zip((start, between, move, emit), want, strict=True)) and abs(total - like) < 1e-9


def test_language_model_tells_long_words_by_digest(spark):
    long, other = "w" * 300_000, "w" * 300_001
    rows = [(i, f"{long} a b {other if i == 4 else 'c'}", None) for i in range(12)]
    assert hmm.known_as([b"a"]) == [b"a"] and len(set(hmm.known_as([long.encode(), other.encode()]))) == 2
    split = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not split(i) for w in [*t.split(), None])
    got = {x.doc_id: x for x in hmm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, _ in rows:
        assert got[i].n_known == sum(counts[w] > 0 for w in [*t.split(), None]) and got[i].train_tokens == sum(counts.values())


def test_label_model_distrusts_a_labeller_with_many_false_alarms():
    """One labeller votes bad on a third of the documents that all others call good."""
    k = len(quality.LABELLERS)
    pattern = lambda bad: int("".join("1" if i in bad else "2" for i in range(k)), 3)
    post, rates, good = quality.fit_label_model({pattern(()): 5000, pattern((4,)): 2500, pattern((0, 1, 2)): 400, pattern((0, 1)): 300, pattern((0, 1, 4)): 100})
    assert abs(rates[4, 1] - 1 / 3) < 0.05 and post[pattern((4,))] > 0.9 and post[pattern(())] > 0.9
    assert max(post[pattern(b)] for b in ((0, 1, 2), (0, 1), (0, 1, 4))) < 0.1 and 0.85 < good < 0.95


def test_label_model_by_plain_rounds():
    """Expectation-maximisation against sums over documents, one at a time."""
    k, r = len(quality.LABELLERS), random.Random(3)
    docs = ["".join(r.choice("0122") for _ in range(k)) for _ in range(60)]
    post, rates, good = quality.fit_label_model(Counter(int(d, 3) for d in docs), rounds=5)
    q, g, weight = [list(quality.RATES) for _ in range(k)], quality.GOOD_SHARE, quality.WEIGHT * len(docs)
    for _ in range(5):
        said, voted, p = [[0.0, 0.0] for _ in range(k)], [[0.0, 0.0] for _ in range(k)], {}
        for d in docs:
            like = [1 - g, g]
            for i, v in enumerate(d):
                for c in range(2):
                    like[c] *= {"0": 1.0, "1": q[i][c], "2": 1 - q[i][c]}[v]
            p[d] = like[1] / sum(like)
            for i, v in enumerate(d):
                for c, share in enumerate((1 - p[d], p[d])):
                    said[i][c] += share * (v == "1")
                    voted[i][c] += share * (v != "0")
        q = [[(said[i][c] + weight * quality.RATES[c]) / (voted[i][c] + weight) for c in range(2)] for i in range(k)]
        g = (sum(p[d] for d in docs) + weight * quality.GOOD_SHARE) / (len(docs) + weight)
    assert np.allclose(rates, q) and abs(good - g) < 1e-12 and all(abs(post[int(d, 3)] - p[d]) < 1e-9 for d in docs)


def test_quality_classifier_against_labels(spark):
    from hardwood.llm.common import table

    sf = SF.replace("sf0.001", "sf0.01")
    out = quality.classify_quality(table(spark, sf, "documents"), columns=["doc_id"]).join(table(spark, sf, "labels"), "doc_id")
    got = {(r["quality"], r["quality_kept"]): r["count"] for r in out.groupBy("quality", "quality_kept").count().collect()}
    good, bad = got.get((1, True), 0) + got.get((1, False), 0), got.get((0, True), 0) + got.get((0, False), 0)
    assert got.get((1, True), 0) >= 0.99 * good and got.get((0, False), 0) >= 0.75 * bad


def test_ratio_by_plain_counts(docs):
    """Weights and scores of the quality rules from counts of 4-grams of bytes, one text at a time."""
    raw, target = Counter(), Counter()
    grams = lambda t: [quality.ngram_buckets(t)[i] for i in range(len(quality.ngram_buckets(t)))]
    for _, t, _ in ROWS:
        if t:
            raw.update(grams(t))
            if quality.trusted(t, quality.text_counts(t)):
                target.update(grams(t))
    b = quality.BUCKETS
    weight = {k: math.log((target[k] + 1) / (sum(target.values()) + b)) - math.log((raw[k] + 1) / (sum(raw.values()) + b)) for k in raw}
    want = Counter((i, round(sum(weight[k] for k in grams(t)) / len(grams(t)), 9) if t else 0.0) for i, t, _ in ROWS)
    out = quality.apply_quality_rules(docs, columns=["doc_id"]).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in out) == want
    for r in out:
        assert r.kept == (not r.base_failed and r.score >= quality.RATIO_THRESHOLD)


def test_rule_counts_by_plain_code(docs):
    for _, t, _ in ROWS + [(0, "a#b\na#b\n \nc|d <e> *\n*", None), (0, "x\n\nx\n\n", None)]:
        ws, seen, again = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set(), 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                again += line in seen
                seen.add(line)
        got = quality.text_counts(t)
        assert (got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == (sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), again)


def test_mixture_keeps_columns_of_any_name_and_draws_by_text_without_doc_id(spark):
    rows = [(None, prose(20), "a", 1, 2) for _ in range(300)] + [(i, prose(20), "b", 3, 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int, mix_copies int")
    out = mixing.emit_mixture(docs)
    assert out.columns == docs.columns and {(r.mix_size, r.mix_copies) for r in out.collect()} == {(1, 2), (3, 4)}
    got = mixing.mix_sources(docs.drop("mix_size", "mix_copies")).where("source = 'b'").groupBy("mix_copies").count().collect()
    assert len(got) >= 1
    a = mixing.mix_sources(docs.drop("mix_size", "mix_copies")).where("doc_id is null").agg(F.sum(F.col("mix_copies") * F.col("mix_size")), F.first("mix_target")).first()
    assert abs(a[0] - a[1]) < 0.15 * a[1]


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    many = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    monkeypatch.undo()
    assert many == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    import corpus_pipeline

    t, u = BASE[0], BASE[1]
    rows = [(1, t, "x"), (5, t, "x"), (5, u, "x"), (5, u, "y"), (None, t, "x"), (None, BASE[2], "x"), (None, changed(BASE[2], 60), "x"), (7, None, "x"), (7, None, "x"), (8, "", "x")]
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]
    assert Counter(r[0] for r in kept) == Counter([1, 5, None, 7, 8]) and (1, t, "x") in kept and len([r for r in kept if r[1] == u]) == 1
    assert not corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], SCHEMA), SF).collect()


def test_jaccard_recursion_over_regions(spark, monkeypatch):
    """Blocks of any size are regions; groups about the threshold split several times, the rest goes in chunks."""
    rows = []
    for g in range(3):
        ws = prose(60).split(" ")
        for i in range(30):
            for k in R.sample(range(60), 2):
                ws[k] = R.choice(WORDS)
            rows.append((1000 * g + i, " ".join(ws), None))
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 7)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_comparison_of_full_chunks_of_short_sets():
    """Two chunks of as many sets as a chunk holds, copies of a few that differ in some shingles."""
    import pyarrow as pa

    r, n = np.random.default_rng(2), jaccard.CHUNK_SETS
    base = r.integers(0, 1 << 63, (10, 12)).astype(np.uint64)
    sets = [np.unique(np.where(r.random(12) < 0.1, r.integers(0, 1 << 63, 12).astype(np.uint64), base[i % 10])) for i in range(2 * n)]
    table = pa.table({"set": np.arange(2 * n), "chunk": np.arange(2 * n) // n, "label": np.arange(2 * n), "raw": pa.array([s.tobytes() for s in sets], pa.binary())})
    out = jaccard._compare(75)((pa.scalar(0), pa.scalar(1)), table).to_pylist()
    for x in out:
        a, b = set(sets[x["set"]].tolist()), set(sets[x["pivot"]].tolist())
        assert 100 * len(a & b) >= 75 * len(a | b)
    assert len(out) > n


def test_warc_headers_of_any_length(spark):
    url = "http://a/" + "".join(R.choice("abcdefghij0123456789") for _ in range(2_000_000))
    pages = spark.createDataFrame([(1, url, "<p>x</p>"), (2, "http://b/", "<p>y</p>")], "page_id long, url string, html string")
    got = {r.page_id: r.url for r in warc.read_warc(warc.write_warc(pages, new_folder(spark, "warc-test")), 1000).collect()}
    assert got == {1: url, 2: "http://b/"}


def test_damaged_records_are_not_passed_over(tmp_path):
    records = [warc.warc_record(i, f"http://{i}/", b"<p>%d</p>" % i * 50, None) for i in range(3)]
    whole = b"".join(records)

    def read(raw, step):
        (tmp_path / "x").write_bytes(raw)
        out = []
        for at in range(0, len(raw), step):
            with open(tmp_path / "x", "rb") as f:
                out += list(warc.scan_range(f, at, min(at + step, len(raw))))
        return out

    size = len(records[0])
    for step in (60, 10_000):
        assert len(read(whole, step)) == 3
        for damaged in (whole[:-20], whole[:size] + b"\x00" + whole[size + 1 :], whole[: size + 60] + b"\xff\xff\xff\xff" + whole[size + 64 :], whole[:size] + b"junk" + whole[size:]):
            with pytest.raises(warc.Damaged):
                read(damaged, step)


def test_warc_with_many_groups(spark, monkeypatch):
    rows = [(i, f"http://{i}/", f"<p>{i % 5}</p>") for i in range(40)]
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    files = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), new_folder(spark, "warc-test"))
    got = warc.read_warc(files, payload=False).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(i, i % 5 if i >= 5 else None) for i in range(40)}


def test_url_model_judges_hosts_that_no_rule_names(spark):
    """Trained on some hosts' labels, the trees tell the URLs of hosts without a rule, by how they are written."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    spam = lambda host: f"http://{host}/{r.randint(10**9, 10**10)}-{r.randint(10**6, 10**7)}/?a={r.random()}&b={r.random()}&c={word(9)}"
    plain = lambda host: f"https://{host}/{word(6)}/{word(8)}"
    rows = [(spam if bad else plain)(f"{'bad' if bad else 'good'}{k}.{r.choice(['com', 'net', 'org'])}") for k in range(40) for bad in (0, 1) for _ in range(20)]
    rules = tuple((("block", f"bad{k}.{t}", "/") if bad else ("allow", f"good{k}.{t}", "/")) for k in range(20) for bad in (0, 1) for t in ("com", "net", "org"))
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    out = urls.judge_urls(pages, rules=rules).where("rule is null").toPandas()
    assert len(out) == 800 and ((out.verdict == "block") == out.host.str.startswith("bad")).mean() > 0.95


def test_urls_without_a_rule_get_scores_of_their_own(spark):
    """On the tables, where the labels follow from host and path alone."""
    out = urls.op2_url_filter(spark, SF.replace("sf0.001", "sf0.01")).toPandas()
    assert out[out["rule"].isna()].block_score.nunique() > 5


def test_sharding_law_by_bytes(docs):
    """With the parameters of the query: the shards' bytes are near equal, and one more shard moves few of them."""
    rows = docs.sparkSession.createDataFrame([(i, "x" * R.randint(0, 400), None) for i in range(4000)], SCHEMA)
    out = sharding.shard_documents(rows, shards=8).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() - loads.mean() <= 0.001 * loads.mean() + 416


def plain_phrases(text):
    """Phrases of the dictionary parse, as tuples of symbols."""
    met, phrase = set(), ()
    for symbol in fingerprints.SYMBOL.findall(text):
        phrase += (symbol,)
        if phrase not in met:
            met.add(phrase)
            phrase = ()
    return met


def test_lempel_ziv_phrases_by_plain_parse():
    some = [" ".join(R.choice(WORDS[:n]) for _ in range(R.randint(1, 400))) for n in (2, 5, 30, 400) for _ in range(40)]
    texts = ["a b a b a b c a b c", "", "x", *BASE[:3], *some]
    for a, b in zip(texts, texts[1:] + texts[:1]):
        mine, other, want_a, want_b = fingerprints.phrases(a), fingerprints.phrases(b), plain_phrases(a), plain_phrases(b)
        # Equal phrases have equal hashes and different ones different hashes, within a text and over two.
        assert (len(mine), len(other), len(mine & other)) == (len(want_a), len(want_b), len(want_a & want_b))


def test_signatures_estimate_the_share_of_common_phrases():
    off = []
    for cut in (30, 75, 150, 225, 270):
        a, b = prose(300), prose(300)
        half = " ".join(a.split()[:cut] + b.split()[cut:])
        mine, other = plain_phrases(a), plain_phrases(half)
        off.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(half)) - len(mine & other) / len(mine | other))
    # Each of the HASHES functions agrees with that probability: five deviations of one, and of their mean.
    assert max(map(abs, off)) < 5 * 0.5 / math.sqrt(fingerprints.HASHES) and abs(sum(off) / 5) < 5 * 0.5 / math.sqrt(5 * fingerprints.HASHES)


def test_url_trees_beat_a_constant_on_hosts_that_they_never_saw(spark):
    """On the tables, whose labels are the query's own rules."""
    h = urls.held_out_verdicts(spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/pages.parquet")).toPandas()
    n, right = h.n.sum(), h[h.verdict == h.judged].n.sum()
    assert right / n > h.groupby("verdict").n.sum().max() / n + 0.1


def test_url_verdicts_where_a_suffix_tells_nothing(spark):
    """URLs of a suffix without labels, or with one kind, are told by how they are written, not blocked as a whole."""
    out = urls.op2_url_filter(spark, SF.replace("sf0.001", "sf0.01")).toPandas()
    rest = out[out["rule"].isna()]
    assert rest.host.str.endswith((".net", ".org")).all()
    share = (rest.verdict == "block").groupby(rest.path.str.split("/").str[1]).mean()
    assert share["en"] > 0.9 and share["de"] < 0.1


def test_movement_of_one_more_shard_at_the_query_s_parameters():
    loads = {c: R.randint(1, 400) for c in range(1 << 16)}
    total, held = sum(loads.values()), {}
    for shards in (40, 41):
        held[shards] = {}
        size = Counter()
        for cell, _, start, shard in sharding.place_cells(loads, shards, 200, 0.001):
            held[shards].setdefault(cell, []).append((start, shard))
        for cell, parts in held[shards].items():
            for (a, s), b in zip(parts, [x for x, _ in parts[1:]] + [loads[cell]], strict=True):
                size[s] += b - a
        assert sum(size.values()) == total and max(size.values()) <= math.ceil(total * 1.001 / shards)
    moved = sum(loads[c] for c in loads if held[40][c][0][1] != held[41][c][0][1])
    # Loads bounded this tightly overflow at most shards, so much moves; far less than dealing anew would (40 of 41).
    assert moved < 0.75 * total
