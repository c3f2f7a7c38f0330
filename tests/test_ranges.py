"""Ranks, running sums, medians and quantiles of skewed groups against plain code, and the repaired joins."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hardwood.operators import joins as J
from hardwood.operators import ranges as R
from hardwood.operators import sequences as Q
from hardwood.operators import state as K
from hardwood.sources.reports import numeric_answers, read_annotations

RANDOM = random.Random(6)


def skewed(n=6000):
    """Two thirds of all rows in one group, heavy ties, a null key, odd numbers."""
    keys = ["hot"] * (n * 2 // 3) + [RANDOM.choice(["a", "b", None]) for _ in range(n // 3)] + ["one", "none"]
    values = [RANDOM.choice([RANDOM.gauss(0, 1), 0.5, 0.5, 1e300 * RANDOM.random(), -1e-300]) for _ in range(n)] + [7.0, None]
    values[5], values[6] = float("nan"), None
    return list(zip(keys, values, range(n + 2), strict=True))


def by_key(rows):
    out = {}
    for k, v, _ in rows:
        if v is not None and v == v:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("few", [10_000, 50])
def test_medians_and_quantiles_of_skewed_groups(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)  # 50: the large groups are narrowed down round by round
    monkeypatch.setattr(R, "BINS", 16 if few == 50 else 1024)
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(6)
    groups = by_key(rows)
    got = {r.k: (r.n, r.median) for r in R.upper_medians(df, ["k"], "v").collect()}
    assert got == {k: (len(v), v[len(v) // 2]) for k, v in groups.items()}
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "top": 1.0}
    got = {r.k: r for r in R.quantiles(df, ["k"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        for name, q in shares.items():
            assert np.isclose(got[k][name], np.quantile(v, q), rtol=1e-12, atol=0), (k, name)
    assert R.upper_medians(df.limit(0), ["k"], "v").count() == 0


def test_numbers_over_ranges(spark):
    rows = skewed(3000)
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = sorted((r.rank, r.i) for r in R.numbered(df, F.desc("k"), "i").collect())
    want = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[2]))
    order = {None: 0} | {k: n for n, k in enumerate(sorted({r[0] for r in rows if r[0]}, reverse=True))}
    want = sorted(rows, key=lambda r: (r[0] is None, order[r[0]], r[2]))
    assert got == [(n + 1, r[2]) for n, r in enumerate(want)]
    assert R.numbered(df.limit(0), "i").count() == 0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_sums_over_one_large_key(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        running_sums_over_one_large_key(spark, 1 if coalesce == "true" else 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def running_sums_over_one_large_key(spark, ranges):
    rows = skewed(4500)
    hot = spark.createDataFrame(rows, "k string, v double, i int").where("k = 'hot'")
    assert R.ranged(hot, "k", "i").select("__range").distinct().count() >= ranges  # a large key is spread over ranges
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5).withColumn("w", F.col("i") % 7)
    got = R.running_sums(df, ["k"], [F.desc("i")], {"s": F.col("w"), "n": F.lit(1)}).toPandas()
    p = pd.DataFrame(rows, columns=["k", "v", "i"]).sort_values("i", ascending=False)
    p["w"] = p.i % 7
    grouped = p.groupby("k", dropna=False)
    want = p.assign(s=grouped.w.cumsum(), n=grouped.cumcount() + 1)
    both = got.merge(want, on="i")
    assert len(both) == len(rows) and (both.s_x == both.s_y).all() and (both.n_x == both.n_y).all()


def test_average_precision_of_a_skewed_class(spark):
    rows = [("hot", RANDOM.random(), i, RANDOM.random() < 0.4) for i in range(3000)] + [("few", RANDOM.random(), i, i % 2 == 0) for i in range(9)]
    df = spark.createDataFrame(rows, "c string, s double, i int, hit boolean")
    n = {"hot": 1500, "few": 5}
    df = df.withColumn("n", F.when(F.col("c") == "hot", n["hot"]).otherwise(n["few"]))
    got = {r.c: r.ap for r in Q.average_precision(df, ["c"], "hit", "n", F.desc("s"), "i").collect()}
    for c, truths in n.items():
        tp, points = 0, []
        for k, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2])), 1):
            tp += r[3]
            points.append((tp / truths, tp / k))
        want = np.mean([max((p for rec, p in points if rec >= step / 100 - 1e-12), default=0.0) for step in range(101)])
        assert abs(got[c] - want) < 1e-9


# --- Repairs --------------------------------------------------------------------------------


def test_frames_without_a_key_keep_their_rows(spark):
    rows = [(None, 1, 0, 0.9, 0.0), (None, 1, 1, 0.8, 50.0), ("v", None, 0, 0.7, 0.0), ("v", None, 1, 0.6, 1.0), ("v", 1, 0, 0.9, 0.0), ("v", 2, 0, 0.9, 0.0), ("v", 2, 1, None, 1.0)]
    df = spark.createDataFrame([(*r[:4], r[4], 0.0, r[4] + 10, 10.0) for r in rows], "video_id string, frame_index long, det_idx int, confidence double, x1 double, y1 double, x2 double, y2 double")
    for f in (K.suppress_overlaps, K.drop_duplicates):
        got = {(r.video_id, r.frame_index, r.det_idx) for r in f(df, 0.45).collect()}
        assert {(None, 1, 0), (None, 1, 1), ("v", None, 0), ("v", 1, 0)} <= got and len(got) == 5, f
    assert K.suppress_overlaps(df.limit(0), 0.45).count() == 0


def test_as_of_clamps_to_the_first_row(spark):
    left = spark.createDataFrame([("a", 1), ("a", 7), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y")], "k string, t int, v string")
    got = lambda clamp: {(r.k, r.t): r.v for r in J.asof_backward(left, right, ["k"], "t", ["v"], clamp).collect()}
    assert got(False) == {("a", 1): None, ("a", 7): "x", ("b", 3): None}
    assert got(True) == {("a", 1): "x", ("a", 7): "x", ("b", 3): None}


def test_spans_of_any_length_meet_their_points(spark):
    spans = [("k", s, s + n, i) for i, (s, n) in enumerate((RANDOM.randint(-500, 10_000), RANDOM.choice([0, 3, 64, 65, 900, 20_000, 10**7])) for _ in range(60))] + [("k", 5, 4, 99)]
    points = [("k", RANDOM.randint(-600, 12_000)) for _ in range(300)] + [("other", 5)]
    a, b = spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(spans, "k string, s long, e long, i int")
    got = sorted((r.at, r.i) for r in J.interval_first(a, b, "k", "at", "s", "e", ["i"], 64).collect())
    want = [(p, min((i for _, s, e, i in spans if s <= p <= e), default=None)) for k, p in points if k == "k"]
    assert got == sorted(w for w in want if w[1] is not None)
    assert J.interval_first(a, b.limit(0), "k", "at", "s", "e", ["i"], 64).count() == 0


def test_malformed_annotations_are_an_error(spark, tmp_path):
    good = '{"image":"a.png","suffix":"12"}\n\n{"image":"b.png","prefix":"Other?","suffix":"7"}\n{"image":"c.png","suffix":"x"}\n'
    (tmp_path / "good.jsonl").write_text(good)
    (tmp_path / "bad.jsonl").write_text(good + '{"image": "d.png", \n')
    rows = read_annotations(spark, str(tmp_path / "good.jsonl"))
    assert [(r.image, r.prefix) for r in rows.collect()] == [("a.png", "Read the number."), ("b.png", "Other?"), ("c.png", "Read the number.")]
    assert [r.image for r in numeric_answers(rows).collect()] == ["a.png"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_annotations(spark, str(tmp_path / "bad.jsonl")).collect()
