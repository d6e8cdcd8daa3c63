"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers and are range-partitioned by length, longest first; a partition is cut into buckets of nearly
equal length. Queries come in blocks of bounded size. A first look at the longest vectors gives each query a score
that its k-th best reaches at least. For a bucket that score, divided by the query's length and the bucket's greatest
length, is a local threshold on the cosine: above 1 the bucket is passed over; where it is high, a candidate's
coordinates must lie near the query's, and the query's largest coordinates pick the few that do; where it is low, the
candidates are the bucket's vectors that are long enough. Products of what is left are computed in full, and the
best k so far raise the threshold for the next bucket. After Teflioudi, Gemulla and Mykytiuk (2015).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.shared import materialize, prepare, table

#: Queries that one pass carries to the tasks, vectors in a bucket, vectors looked at first.
QUERY_BLOCK, BUCKET, FIRST = 16_384, 512, 2_048
#: Bytes of the vectors of a block of queries, which make a block smaller where vectors are wide.
QUERY_BYTES = 32 << 20
#: Local threshold from which on coordinates prune, and the number of coordinates used.
COORDINATES_FROM, FOCUS = 0.6, 3
#: Integers beyond which products might not be exact in double precision.
EXACT = float(1 << 53)
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


def integers(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", unit: int = 256) -> DataFrame:
    """(vec_id, v array<double>, norm double): each component x as floor(unit * x). Rows whose vector is null or holds
    a null, a NaN or an infinity are left out."""
    x = F.col(embedding)
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    # Doubles of 2^53 or more are whole already.
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    v = F.transform(x, lambda e: whole(e.cast("double") * unit))
    out = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def matrix(column, dims: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; shorter rows are filled up with zeros."""
    rows = column.to_pylist() if hasattr(column, "to_pylist") else column
    dims = dims or max(map(len, rows), default=0)
    out = np.zeros((len(rows), dims))
    for k, r in enumerate(rows):
        out[k, : min(len(r), dims)] = r[:dims]
    return out


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, as integers or, where they are small enough, whole doubles."""
    most = p.shape[-1] * float(np.abs(p).max(initial=0)) * float(np.abs(q).max(initial=0))
    if most < EXACT:
        return p @ q
    big = np.frompyfunc(int, 1, 1)(p) @ np.frompyfunc(int, 1, 1)(q)
    return np.frompyfunc(lambda x: max(LONG_MIN, min(LONG_MAX, int(x))), 1, 1)(big)


class Best:
    """The k best (score, vec_id) of a query so far; ties go to the smaller id, null ids last."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, ids, scores) -> None:
        if len(scores) > self.k:
            order = np.argpartition(scores, len(scores) - self.k)
            least = scores[order[len(scores) - self.k]]
            keep = scores >= least
            ids, scores = ids[keep], scores[keep]
        rows = self.rows + [(int(s), i) for s, i in zip(scores, ids, strict=True)]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        self.rows = rows[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, float(self.rows[-1][0]))


def search_bucket(ids: np.ndarray, p: np.ndarray, norms: np.ndarray, queries, qnorms, qids, best: list[Best]) -> dict:
    """Look one bucket (longest first) up for all queries; returns how often each kind of pruning was chosen."""
    used = {"passed": 0, "coordinates": 0, "lengths": 0}
    longest = norms[0]
    unit = np.divide(p, norms[:, None], out=np.zeros_like(p), where=norms[:, None] > 0)
    floors = np.array([b.floor for b in best])
    scale = qnorms * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(scale > 0, floors / scale, np.where(floors > 0, np.inf, -np.inf))
    slack = 1e-9
    used["passed"] = int((local > 1 + slack).sum())
    by_length = np.flatnonzero(local < COORDINATES_FROM)
    used["lengths"] = len(by_length)
    for n in by_length:
        floor = best[n].floor
        long_enough = len(norms)
        if floor > 0 and qnorms[n] > 0:
            long_enough = int(np.searchsorted(-norms, -(floor / qnorms[n]) * (1 - slack), "right"))
        _verify(ids[:long_enough], p[:long_enough], queries[n], qids[n], best[n])
    for n in np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + slack)):
        used["coordinates"] += 1
        q, t = queries[n] / qnorms[n], min(1.0, local[n])
        keep = np.ones(len(ids), bool)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            # A unit vector with cosine t or more to q has its f-th coordinate within this interval.
            mid, half = t * q[f], math.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
            low = -1.0 if q[f] <= -t else mid - half
            high = 1.0 if q[f] >= t else mid + half
            keep &= (unit[:, f] >= low - slack) & (unit[:, f] <= high + slack)
        _verify(ids[keep], p[keep], queries[n], qids[n], best[n])
    return used


def _verify(ids, p, q, qid, best: Best) -> None:
    other = ids != qid
    if other.any():
        scores = products(p[other], q)
        keep = scores >= best.floor if len(best.rows) == best.k or best.floor > -np.inf else np.ones(len(scores), bool)
        best.add(ids[other][keep], scores[keep])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query among all other rows.

    vectors and queries are integers() tables. A row with the query's own id is no candidate of it; of queries that
    share an id, the smallest vector counts. Queries of a null id are left out; candidates of a null id come last
    among ties. Vectors of unequal length are filled up with zeros. Fewer than k candidates give fewer rows; empty
    tables give an empty result. Scores beyond a long stop at its bounds.

    Queries are dealt into blocks. A pass over the vectors answers a block: its queries, bounded by QUERY_BLOCK and
    QUERY_BYTES, go through the driver to the tasks, its result is written to the shared folder, and only then the next
    block's queries are fetched, so neither the driver nor a task holds more however many queries there are. Each
    partition returns k rows a query at most; a window picks k.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = materialize(vectors, "vectors")
    asked = queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = max(1, math.ceil(asked.count() / min(QUERY_BLOCK, max(1, QUERY_BYTES // max(1, 8 * dims)))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks - 1 if blocks > 1 else 1)).cast("int"))
    asked = materialize(asked, "queries")
    # The longest vectors: their least norm first, as numbers only, then the vectors of that norm or more.
    least = vectors.select("norm").orderBy(F.desc("norm")).limit(FIRST).agg(F.min("norm")).first()[0]
    first = vectors.where(F.col("norm") >= F.lit(least)).limit(FIRST).select("vec_id", "v").collect() if least is not None else []
    ordered = materialize(vectors.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm")), "by-length")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score long"
    lead_ids, lead = np.array([r[0] for r in first], object), matrix([r[1] for r in first], dims)
    paths, answers = [], Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    for block in range(2 * blocks - 1):
        rows = asked.where(F.col("block") == block).select("vec_id", "v").collect()
        if not rows:
            continue
        qids = np.array([r[0] for r in rows], object)
        q = matrix([r[1] for r in rows], dims)
        floors = []
        for x, name in zip(q, qids, strict=True):
            b = Best(k, -np.inf)
            _verify(lead_ids, lead, x, name, b)
            floors.append(b.floor)
        shared = spark.sparkContext.broadcast((qids, q, np.sqrt((q * q).sum(axis=1)), floors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q, qnorms, floors = shared.value
            best = [Best(k, f) for f in floors]
            for b in batches:
                ids, norms = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(zero_copy_only=False)
                p = matrix(b.column(1), q.shape[1])
                for s in range(0, len(ids), BUCKET):
                    e = slice(s, s + BUCKET)
                    order = np.argsort(-norms[e], kind="stable")
                    search_bucket(ids[e][order], p[e][order], norms[e][order], q, qnorms, qids, best)
            found = [(name, i, s) for name, x in zip(qids, best, strict=True) for s, i in x.rows]
            for s in range(0, len(found), 65_536):
                part = list(zip(*found[s : s + 65_536], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.array(part[0]).type), pa.array(part[2], pa.int64())], names=["query_id", "vec_id", "score"])

        ranked = ordered.mapInArrow(run, schema).withColumn("rank", F.row_number().over(answers)).where(F.col("rank") <= k)
        ranked = materialize(ranked.select("query_id", "rank", "vec_id", "score"), "answers")
        shared.destroy()
        paths.append(ranked._materialized_path)
    if not paths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    return spark.read.schema(ranked.schema).parquet(*paths)


def op10_topk(spark, sf_dir):
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
