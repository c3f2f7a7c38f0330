"""URL filter: allow and block rules, and gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.llm.common import ascii_lower, join_hot, table, written

#: (verdict, host, path prefix): a rule fits its host and all subdomains; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The trees learn from the labelled URLs whose hashes are smallest, at most this many.
TRAIN_ROWS = 10_000
#: Labelled URLs assumed of each suffix beforehand, half of them blocked; labels of either kind that its rate needs; folds by host.
PRIOR, NEUTRAL_RATE, LEAST_LABELS, FOLDS = 20.0, 0.5, 20, 5
#: Boosting rounds, and depth of a tree.
ROUNDS, DEPTH = 20, 4
#: Suffixes, one row each, are broadcast up to this many.
BROADCAST_SUFFIXES = 100_000
FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_host_parts", "f_digit_ratio", "f_host_digit_ratio", "f_hyphens",
    "f_entropy", "f_host_entropy", "f_path_entropy", "f_first_length", "f_first_char", "f_first_end", "f_first_vowels", "f_host_first_length", "f_host_char",
    "f_last_length", "f_last_digits", "f_params", "f_fragment", "f_https", "f_suffix_share", "f_suffix_rate",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Ties: first by text."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        hit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        fit = F.when(hit, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.char_length(F.replace(text, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, fit and the features that need no corpus statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    digits = lambda c: F.char_length(F.regexp_replace(c, "[^0-9]", ""))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    labels, last = F.split("host", r"\."), F.try_element_at(parts, F.lit(-1))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    code = lambda c: F.ascii(c).cast("double")
    return base.select(
        "page_id",
        "url",
        "host",
        "path",
        rule_column(F.col("host"), F.col("path"), rules).alias("fit"),
        F.element_at(labels, -1).alias("suffix"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
        F.char_length("url").cast("double").alias("f_length"),
        F.char_length("host").cast("double").alias("f_host_length"),
        F.char_length("path").cast("double").alias("f_path_length"),
        F.size(parts).cast("double").alias("f_depth"),
        F.size(labels).cast("double").alias("f_host_parts"),
        _share(digits(F.col("url")), F.char_length("url")).alias("f_digit_ratio"),
        _share(digits(F.col("host")), F.char_length("host")).alias("f_host_digit_ratio"),
        F.regexp_count("url", F.lit("-")).cast("double").alias("f_hyphens"),
        entropy(F.col("url")).alias("f_entropy"),
        entropy(F.col("host")).alias("f_host_entropy"),
        entropy(F.col("path")).alias("f_path_entropy"),
        F.char_length(first).cast("double").alias("f_first_length"),
        code(first).alias("f_first_char"),
        code(F.right(first, F.lit(1))).alias("f_first_end"),
        _share(F.char_length(F.regexp_replace(first, "[^aeiouAEIOU]", "")), F.char_length(first)).alias("f_first_vowels"),
        F.char_length(F.get(labels, F.lit(0))).cast("double").alias("f_host_first_length"),
        code(F.col("host")).alias("f_host_char"),
        F.coalesce(F.char_length(last), F.lit(0)).cast("double").alias("f_last_length"),
        _share(digits(F.coalesce(last, F.lit(""))), F.char_length(last)).alias("f_last_digits"),
        F.when(F.contains("url", F.lit("?")), F.regexp_count("url", F.lit("[?&][^&#]"))).otherwise(0).cast("double").alias("f_params"),
        F.contains("url", F.lit("#")).cast("double").alias("f_fragment"),
        F.startswith("url", F.lit("https://")).cast("double").alias("f_https"),
    )


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with each suffix's share of all URLs (in powers of two) and its rate of blocked ones among the labelled.

    The rate leaves out the labels of the row's own fold of hosts, so no URL's feature knows its own
    label, nor that of its host. A suffix without LEAST_LABELS labels of either kind tells nothing: its rate is
    NEUTRAL_RATE. One row per suffix is joined back.
    """
    block = (F.col("fit.verdict") == "block").cast("int")
    folds = [F.struct(F.count(F.when(F.col("fold") == k, F.col("fit.verdict"))).alias("n"), F.coalesce(F.sum(F.when(F.col("fold") == k, block)), F.lit(0)).alias("blocked")) for k in range(FOLDS)]
    per = rows.groupBy("suffix").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("double").alias("f_suffix_share"), F.array(*folds).alias("folds"))
    per = written(per, "url-suffixes")
    met = rows.join(F.broadcast(per), "suffix") if per.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES else join_hot(rows, per, "suffix")
    others = F.filter("folds", lambda x, i: i != F.col("fold"))
    total = lambda name: F.aggregate(others, F.lit(0).cast("long"), lambda a, x: a + x[name])
    met = met.withColumns({"__n": total("n"), "__blocked": total("blocked")})
    told = (F.col("__blocked") >= LEAST_LABELS) & (F.col("__n") - F.col("__blocked") >= LEAST_LABELS)
    rate = (F.col("__blocked") + PRIOR * NEUTRAL_RATE) / (F.col("__n") + PRIOR)
    return met.withColumn("f_suffix_rate", F.when(told, rate).otherwise(NEUTRAL_RATE)).drop("folds", "__n", "__blocked")


def _train(features: DataFrame, rounds: int, depth: int, train_rows: int, seed: int) -> GBTClassificationModel | None:
    """Trees from at most ``train_rows`` labelled rows; None unless both kinds are among them.

    Each row is learnt from twice, once with a neutral suffix rate. So where a suffix tells nothing, what decides is how
    URLs of all suffixes are written, not which suffixes happen to have one kind of labels only.
    """
    labelled = features.where("fit is not null")
    pick = labelled.orderBy(F.xxhash64("url"), "page_id").limit(train_rows)
    rows = written(pick.select((F.col("fit.verdict") == "block").cast("double").alias("label"), *FEATURES), "url-train")
    blocked, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if blocked in (0, n):
        return None
    rows = rows.unionByName(rows.withColumn("f_suffix_rate", F.lit(NEUTRAL_RATE)))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
    # One partition in one order, so that a rerun bins and splits alike; the rows are bounded.
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.coalesce(1).sortWithinPartitions("label", *FEATURES))
    fit = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, seed=seed, checkpointInterval=-1, cacheNodeIds=False)
    return fit.fit(data)


def _scored(model: GBTClassificationModel, features: DataFrame) -> DataFrame:
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    return model.transform(data).withColumn("block_score", vector_to_array("probability")[1])


def _prepared(pages: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """The rows of ``lexical``, written, and the same with what the suffixes say."""
    rows = written(lexical(pages.select("page_id", "url"), rules), "url-features")
    return rows, with_suffix_statistics(rows)


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, rounds: int = ROUNDS, depth: int = DEPTH, train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score for every row of ``pages`` (page_id, url).

    A rule's verdict stands. The URLs that a rule fits are the labelled ones: gradient-boosted
    trees learn from at most ``train_rows`` of them, those with the smallest hashes, and judge
    every other URL: block if its probability is at least ``threshold``. Features: lengths, depth,
    digit ratios, entropies, parameters, the characters that the path's first segment and the host begin and end
    with, and each suffix's frequency and, out of fold, its blocked rate over all URLs.

    Null or malformed URLs have empty host and path and are judged like others. Repeated rows are
    judged alike. If no URL, or only one kind, is labelled, the rest get that kind's verdict, or
    ``allow``. Extra columns are ignored; an empty table gives no rows.

    The statistics are aggregated before they are shuffled, and one row per suffix is joined back.
    """
    rows, features = _prepared(pages, rules)
    model = _train(features, rounds, depth, train_rows, seed)
    if model is None:
        kinds = [r[0] for r in rows.where("fit is not null").select("fit.verdict").distinct().collect()]
        scored = features.withColumn("block_score", F.lit(1.0 if kinds == ["block"] else 0.0))
    else:
        scored = _scored(model, features)
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "block_score")


def held_out_verdicts(pages: DataFrame, rules=RULES, threshold: float = 0.5, rounds: int = ROUNDS, depth: int = DEPTH, train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """fold, rule, verdict (the rule's), judged and n: what trees that saw no host of a fold say of its labelled URLs.

    Suffix rates leave out the fold as well. Folds of which no trees can be fitted are left out.
    """
    _, features = _prepared(pages, rules)
    out = []
    for k in range(FOLDS):
        model = _train(features.where(F.col("fold") != k), rounds, depth, train_rows, seed)
        if model is not None:
            out.append(_scored(model, features.where((F.col("fold") == k) & F.col("fit").isNotNull())).withColumn("judged", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))
    if not out:
        return features.where("false").select("fold", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.lit("").alias("judged"), F.lit(0).cast("long").alias("n"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("fold", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "judged").agg(F.count("*").alias("n"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
