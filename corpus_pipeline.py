"""From raw documents to token ids: five stages, each written as Parquet before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of their input, whatever those are, and every row that the
stage keeps. Nulls, empty texts, repeated rows and empty tables have the results that the
operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import table, written
from hardwood.llm.jaccard import keep_one
from hardwood.llm.mixing import emit_mixture
from hardwood.llm.pieces import default_model, encode_documents
from hardwood.llm.quality import apply_quality_rules, classify_quality


def _kept(docs: DataFrame, judge, flag: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` flags; columns that ``docs`` has of its own stay as they are."""
    aside = {c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text")}
    judged = judge(docs.withColumnsRenamed(aside))
    return judged.where(flag).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier doesn't reject, as they are.

    A null or empty text is judged like any other. Rows that repeat are judged alike and all stay or go. An empty
    table gives no rows.
    """
    return _kept(docs, classify_quality, "quality_kept")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the rules and the log-likelihood ratio keep, as they are.

    A null or empty text has too few words and goes. Rows that repeat stay or go together. An empty table gives no rows.
    """
    return _kept(docs, apply_quality_rules, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, a null last.

    Texts without words, or null, stay; of rows that repeat both doc_id and text one does. An empty
    table gives no rows.
    """
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it: none to three times.

    Null sources are one source. A null text has no words and is taken like its source's others. Rows without a doc_id
    draw by their text, and rows that repeat draw alike. An empty table gives no rows.
    """
    return emit_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text, a row for each of ``docs``.

    A null text is empty: its ids are those of begin and end. A null doc_id stays null, repeated rows are encoded one by
    one. An empty table gives no rows.
    """
    out = encode_documents(docs, default_model())
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: Trained weights, graph components and subword merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
