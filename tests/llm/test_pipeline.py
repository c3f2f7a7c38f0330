"""Every stage of the pipeline on usual, odd and empty tables, and the whole of it against its stages; hot keys of joins."""

import random

import pytest
from pyspark.sql import functions as F

from hardwood.llm import common, jaccard
from hardwood.llm.pieces import default_model
from tests.conftest import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = corpus_pipeline.STAGES
R = random.Random(9)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["".join(R.choice("aeiourstln") for _ in range(R.randint(2, 8))) for _ in range(300)]


def prose(n):
    return ". ".join(" ".join(R.choice(WORDS) for _ in range(12)).capitalize() for _ in range(n // 12)) + "."


def made():
    out = [(i, prose(150), "en", f"s{i % 3}", 1) for i in range(40)]
    out += [(100 + i, out[i][1], "en", "s0", 1) for i in range(5)]
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n ", "en", None, 3), (None, out[6][1], "en", "s1", 1), (None, None, None, None, None), (203, out[7][1], "en", "s1", 1), (203, out[7][1], "en", "s1", 1)]
    return out


ROWS = made()


def rows():
    return ROWS


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name,stage", STAGES)
def test_stages_on_empty_tables(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], SCHEMA), SF)
    assert out.count() == 0
    if name != STAGES[-1][0]:
        assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


@pytest.mark.parametrize("name,stage", STAGES[:-1])
def test_stages_keep_columns_and_rows_of_their_input(spark, name, stage):
    """Extra columns whose names clash with those of the operators stay as they are, and no row is made up."""
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({"__row": F.lit(1), "kept": F.lit("k"), "quality_kept": F.lit(False), "row": F.lit("r"), "size": F.lit(2), "target": F.lit("t"), "__own": F.lit(3.0)})
    out = stage(spark, df, SF)
    assert out.columns == df.columns
    given = as_rows(df)
    assert set(as_rows(out)) <= set(given)
    if name == "near_duplicates":
        got = as_rows(out.select("doc_id", "text"))
        assert len(got) == len(set(got)) and {i for i, _ in got if i is not None} >= {*range(40), 200, 201, 202} and not {i for i, _ in got} & {*range(100, 105), 203}
    if name == "mix":
        assert out.count() >= 20


def test_encode_gives_the_library_s_ids(spark):
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows(), SCHEMA), SF).collect()
    want = [[model.bos_id(), *model.encode(t or ""), model.eos_id()] for _, t, *_ in rows()]
    assert sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got) == sorted(want) and all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = as_rows(corpus_pipeline.run(spark, str(tmp_path)))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), name) if name != STAGES[-1][0] else stage(spark, docs, str(tmp_path))
    assert got == as_rows(docs) and got


def test_one_row_repeated_very_often_stays_once(spark):
    text = prose(60)
    df = spark.createDataFrame([(None, text, "en", "s", 1)] * 3000 + [(7, text + " more", "en", "s", 1)], SCHEMA).repartition(4)
    assert [r.doc_id for r in jaccard.keep_one(df).collect()] == [7]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_of_frequent_keys(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    keys = ["hot"] * 100 + ["lost"] * 90 + [None] * 80 + ["warm"] * 30 + ["also"] * 25 + list("abcabd")
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    one = spark.createDataFrame([("hot", 1), ("warm", 2), ("also", 3), ("a", 4), ("z", 5)], "k string, v int")
    assert as_rows(common.join_hot(df, one, "k", how).select("i", "k", "v")) == as_rows(df.join(one, "k", how).select("i", "k", "v"))
