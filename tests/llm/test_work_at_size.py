"""What operators do once tables are too large to broadcast, at a size that shows it."""

import re
import tracemalloc
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from hardwood.llm import hmm, importance, jaccard


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def fed_by_raw(plan: str) -> list[str]:
    """The lines of a plan that its scans of shingles feed."""
    lines, out = plan.splitlines(), []
    depth = [re.match(r"[\s:|+-]*", x).end() for x in lines]
    for i, text in enumerate(lines):
        if "FileScan" in text and "raw#" in text:
            for j in range(i, -1, -1):
                if j == i or depth[j] < d:
                    out.append(lines[j])
                    d = depth[j]
    return out


def test_sets_stay_where_they_are_when_pairs_are_measured(spark, no_broadcast, monkeypatch):
    """Stored sets meet the pairs in their buckets; the links are those of plain code and no table is left behind."""
    text = lambda i: " ".join(f"w{i // 4}x{k}" if k % 40 or i % 4 == 0 else f"x{i}y{k}" for k in range(20, 150))
    texts = [text(i) for i in range(16)]
    plans, measure = [], jaccard._measure

    def seen(members, hubs, percent):
        plans.append([x._jdf.queryExecution().executedPlan().toString() for x in (members, hubs)])
        return measure(members, hubs, percent)

    monkeypatch.setattr(jaccard, "_measure", seen)
    before = spark.catalog.listTables()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert spark.catalog.listTables() == before
    # The first are the sets as they are stored, the others those of pairs.
    assert len(plans) > 1
    for plan in (p for both in plans[1:] for p in both):
        lines = fed_by_raw(plan)
        assert lines and any("Join" in x for x in lines) and not any("Exchange" in x for x in lines), plan
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    label = list(range(16))
    for _ in label:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label)) and len(set(label)) == 4


def test_baum_welch_holds_few_pieces_at_once():
    """However many pieces there are, the arrays of a pass are those of a few; the counts are the same in any batches."""
    r = np.random.default_rng(2)
    model = hmm.Model.seeded(r.dirichlet(np.ones(hmm.CLASSES + 1)))
    docs = [r.integers(0, hmm.CLASSES, n) for n in (128, 900, 1)] * 400
    tracemalloc.start()
    got = hmm.batched_counts(model, iter(docs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for a, b in zip(got, hmm.batched_counts(model, iter(docs), 77), strict=True):
        assert np.allclose(a, b, rtol=1e-9)


def test_scores_of_sequences_longer_than_go_side_by_side():
    r = np.random.default_rng(4)
    model = hmm.Model.seeded(r.dirichlet(np.ones(hmm.CLASSES + 1)))
    seqs = [r.integers(0, hmm.CLASSES, n) for n in (hmm.LONG + 1, 1, hmm.LONG, 3 * hmm.LONG, 600)]
    for s, got in zip(seqs, hmm.log_likelihoods(model, seqs, 2), strict=True):
        state, total = model.start, 0.0
        for x in s:
            state = (state @ model.move) * model.emit[:, x]
            total += np.log(state.sum())
            state = state / state.sum()
        assert abs(total - got) < 1e-9 * abs(total)


def test_resampling_holds_few_blocks_at_once(spark, monkeypatch):
    """However much a task reads, a row group, which it holds as a whole, is a few MB of blocks, and all rows are there."""
    r = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in r.integers(0, 50_000, 4000)) + " the" * 300) for i in range(400)]
    tables, write = {}, importance.written
    monkeypatch.setattr(importance, "written", lambda df, name, *rest: tables.setdefault(name, write(df, name, *rest)))
    out = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([("w1 the",)], "text string"))
    got = sorted(out.collect())
    assert [(x.doc_id, x.n_features) for x in got] == [(i, 2 * 4300 - 1) for i in range(400)]
    assert sorted(x.rank for x in got if x.rank) == list(range(1, 101))
    (file,) = tables["csr"].inputFiles()
    meta = pq.ParquetFile(urlparse(file).path).metadata
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 6 << 20
