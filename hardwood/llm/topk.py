"""Exact top-k search by inner product: query rows scatter weighted postings into dense score arrays."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.llm.common import table, written

#: Components are multiplied by this and floored; results of each query.
SCALE, TOP = 1024, 10
#: Every so many ids one is a query.
EVERY = 100
#: A cell of candidates, and a block of queries, hold about so many components at most, a cell so many rows at least.
CELL_VALUES, LEAST_ROWS = 1 << 22, 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1

FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


class Postings:
    """For each component the candidates that have it, and their weights there.

    Candidates are held in the order of their ids (null last), then of their rows.
    """

    def __init__(self, rows: np.ndarray, ids: list, offsets: np.ndarray, values: np.ndarray):
        order = np.lexsort((rows, [MOST if i is None else i for i in ids], [i is None for i in ids]))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.size, self.rows, self.ids = len(rows), rows[order], [ids[i] for i in order]
        self.at_row = np.argsort(self.rows)
        lengths = np.diff(offsets)
        terms = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        held = np.flatnonzero(values)
        who = np.repeat(place, lengths)[held]
        terms, values = terms[held], values[held]
        by = np.lexsort((who, terms))
        self.who, self.weights = who[by], values[by]
        self.starts = np.searchsorted(terms[by], np.arange(int(lengths.max(initial=0)) + 1))
        self.largest = max(-int(values.min(initial=0)), int(values.max(initial=0)))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Inner products of all candidates with a query, one term of it after the other."""
        wide = max(-int(query.min(initial=0)), int(query.max(initial=0))) * self.largest * max(len(query), 1) > MOST
        kind = object if wide else np.int64
        out = np.zeros(self.size, kind)
        for term in np.flatnonzero(query[: len(self.starts) - 1]):
            part = slice(self.starts[term], self.starts[term + 1])
            add = self.weights[part].astype(kind, copy=False) * (int(query[term]) if wide else query[term])
            if len(add) == self.size:  # the posting of a term that all have, in order
                out += add
            else:
                out[self.who[part]] += add
        return np.clip(out, LEAST, MOST).astype(np.int64) if wide else out

    def best(self, query: np.ndarray, own: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``top`` candidates other than row ``own``, of equal scores the first in order."""
        s = self.scores(query)
        at = np.searchsorted(self.rows, own, sorter=self.at_row)
        mine = self.at_row[at] if at < self.size and self.rows[self.at_row[at]] == own else -1
        k = min(top + (mine >= 0), self.size)
        if k == 0:
            return np.zeros(0, np.int64), s
        bar = np.partition(s, self.size - k)[self.size - k]
        above, level = np.flatnonzero(s > bar), np.flatnonzero(s == bar)
        # One more than needed of those at the bar, should the query's own row be among them.
        pick = np.concatenate([above, level[: k - len(above) + 1]])
        pick = pick[pick != mine]
        pick = pick[np.lexsort((pick, -s[pick].astype(object) if (s[pick] == LEAST).any() else -s[pick]))][:top]
        return pick, s[pick]


def _columns(rows: pa.Table) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    vectors = rows.column("v").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    return rows.column("row").to_numpy(), rows.column("vec_id").to_pylist(), vectors.offsets.to_numpy().astype(np.int64), vectors.flatten().to_numpy()


def _searched(top: int):
    """A function from a cell's candidates and a block of queries to the best of the cell for each query."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        postings = Postings(*_columns(candidates))
        rows, ids, offsets, values = _columns(queries)
        offsets = offsets - offsets[0]
        out = []
        for i, own in enumerate(rows.tolist()):
            places, scores = postings.best(values[offsets[i] : offsets[i + 1]], own, top)
            n = len(places)
            out.append((np.full(n, own), [ids[i]] * n, [postings.ids[p] for p in places], postings.rows[places], scores[:n]))
        flat = [np.concatenate([o[j] for o in out]) if j in (0, 3, 4) else [x for o in out for x in o[j]] for j in range(5)]
        return pa.table([pa.array(c, pa.int64()) for c in flat], schema=schema)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score: the ``top`` rows of ``vectors`` (vec_id, embedding) with the highest
    inner products of scaled components for every row that ``is_query`` names, among all rows but itself.

    Ties go to the smaller vec_id, null last, then to the row read first. A vector that is null or holds
    a null, NaN or infinite component takes no part; the shorter of two counts as 0 beyond its end, so an empty
    one scores 0 with all. Components and scores beyond 64 bits count as the greatest or least long. Rows that
    repeat a vec_id are rows of their own, as queries too, and then share a query_id. Extra columns are
    ignored; an empty table gives no rows.

    Every query meets every row, but in tiles: candidates are dealt to cells and queries to blocks of
    a bounded size; a task inverts one cell and scores one block against it. Of a tile only ``top`` rows a query
    go on, and Spark keeps ``top`` of a query in each task before the last shuffle.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("e"), is_query.alias("q")).where(is_finite(F.col("e")))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("e"), scale).alias("v"), F.coalesce("q", F.lit(False)).alias("q")), "vectors")
    size = F.greatest(F.size("v"), F.lit(1))
    n, values, asked = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("q"), size)), F.lit(0))).first()
    slots = spark.sparkContext.defaultParallelism
    cells = max(-(-values // CELL_VALUES), min(slots, n // LEAST_ROWS), 1)
    blocks = max(-(-asked // CELL_VALUES), 1)
    deal = lambda k: F.pmod(F.xxhash64("row"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    candidates = rows.select("row", "vec_id", "v", deal(cells).alias("cell"), every(blocks).alias("block"))
    queries = rows.where("q").select("row", "vec_id", "v", every(cells).alias("cell"), deal(blocks).alias("block"))
    found = candidates.groupBy("cell", "block").cogroup(queries.groupBy("cell", "block")).applyInArrow(_searched(top), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


OP11_SQL = f"""with v as (select row_number() over () r, vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] a from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
 s as (select q.r, q.vec_id query_id, c.vec_id, c.r cr, cast(list_dot_product(cast(q.a as double[]), cast(c.a as double[])) as bigint) score from v q join v c on q.r <> c.r where q.vec_id % {EVERY} = 0),
 k as (select *, row_number() over (partition by r order by score desc, vec_id nulls last, cr) n from s)
 select query_id, cast(n as integer) as rank, vec_id, score from k where n <= {TOP}"""


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
