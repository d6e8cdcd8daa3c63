"""Hard negatives within a score window, by branch and bound over ball trees.

Vectors become integers and are dealt out by label. Every task builds ball trees over its rows, a chunk at a time: runs
of one label have trees of their own, the rest share one. A node's centre and radius bound the inner product of an
anchor with all of its vectors from both sides: |q.x - q.c| <= |q| r. A node is left out where the anchor wants other
labels, where the bounds lie outside the window, or where the upper one is strictly beneath the k-th best so far. All
anchors of a block go down a tree together, as arrays, and only those that still want a node are multiplied with it.

The search runs twice a block: for the positives, which have no window, and, with the windows that their scores
give, for the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm import topk
from scriptoria.llm.shared import materialize, prepare, table

#: Anchors that one pass carries to the tasks, bytes of their vectors, anchors that go down a tree together.
ANCHOR_BLOCK, ANCHOR_BYTES, TOGETHER = 8_192, 16 << 20, 1_024
#: Vectors of a tree and of a leaf, vectors looked at first.
CHUNK, LEAF, FIRST = 16_384, 256, 2_048
#: Share of a bound's scale that rounding may cost.
SLACK = 1e-9


@dataclass
class Wanted:
    """What a block's searches look for: search s belongs to anchor of[s] and takes scores in [low[s], high[s]]."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    k: int
    same_label: bool
    found: list[list[tuple]] = field(default_factory=list)

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.floor = self.floor.copy()
        self.found = [[] for _ in self.of]

    def add(self, s: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = self.found[s] + [(int(x), i) for x, i in zip(scores, ids, strict=True)]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        self.found[s] = rows[: self.k]
        if len(rows) >= self.k:
            self.floor[s] = max(self.floor[s], float(self.found[s][-1][0]))


class BallTree:
    """Nested balls over rows first to last of p, which it puts into the order of its leaves."""

    def __init__(self, p: np.ndarray, label: int | None):
        self.order, self.label, self.nodes = np.arange(len(p)), label, []
        waiting = [(0, len(p), -1)]
        while waiting:
            start, end, parent = waiting.pop()
            rows = p[self.order[start:end]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            node = len(self.nodes)
            self.nodes.append([start, end, centre, float(away.max(initial=0.0)), []])
            if parent >= 0:
                self.nodes[parent][4].append(node)
            if end - start > LEAF and self.nodes[node][3] > 0:
                # Split across the line between a far row and the row farthest from it.
                a = rows[away.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(rows @ (b - a), half)]
                waiting += [(start, start + half, node), (start + half, end, node)]

    def search(self, p: np.ndarray, ids: np.ndarray, labels: np.ndarray, want: Wanted, searches: np.ndarray) -> int:
        """Look the tree up for these searches; returns the number of (node, search) pairs that bounds left out."""
        if self.label is not None:
            same = want.labels[want.of[searches]] == self.label
            searches = searches[same if want.same_label else ~same]
        pruned, waiting = 0, [(0, searches)]
        while waiting:
            node, active = waiting.pop()
            start, end, centre, radius, below = self.nodes[node]
            anchor = want.of[active]
            middle = (want.vectors @ centre)[anchor] if 2 * len(active) > len(want.vectors) else want.vectors[anchor] @ centre
            reach = want.norms[anchor] * radius
            reach += SLACK * (reach + want.norms[anchor] * math.sqrt(float(centre @ centre))) + SLACK
            keep = (middle + reach >= np.maximum(want.low[active], want.floor[active])) & (middle - reach <= want.high[active])
            pruned += len(active) - int(keep.sum())
            active = active[keep]
            if len(active) and below:
                waiting += [(n, active) for n in below]
            elif len(active):
                at = self.order[start:end]
                verify(p[at], ids[at], labels[at], want, active)
        return pruned


def verify(p: np.ndarray, ids: np.ndarray, labels: np.ndarray, want: Wanted, active: np.ndarray) -> None:
    """Exact products of these rows with the anchors of these searches, and the best of those that are asked for."""
    for s in range(0, len(active), TOGETHER):
        part = active[s : s + TOGETHER]
        anchors, back = np.unique(want.of[part], return_inverse=True)
        scores = topk.products(want.vectors[anchors], p.T)[back]
        alike = want.labels[anchors][back][:, None] == labels[None, :]
        fit = (alike if want.same_label else ~alike) & (want.ids[anchors][back][:, None] != ids[None, :])
        fit &= (scores >= np.maximum(want.low[part], want.floor[part])[:, None]) & (scores <= want.high[part][:, None])
        if len(p) > want.k:
            # Of each search no score beneath the k-th of this leaf.
            kth = np.sort(np.where(fit, scores, -np.inf), axis=1)[:, -want.k]
            fit &= scores >= kth[:, None]
        for r in np.flatnonzero(fit.any(axis=1)):
            want.add(int(part[r]), scores[r, fit[r]], ids[fit[r]])


def search_chunk(p: np.ndarray, ids: np.ndarray, labels: np.ndarray, want: Wanted) -> int:
    """Search a chunk by trees: one for each label that fills a leaf, one for the rest."""
    pruned, everything = 0, np.arange(len(want.of))
    values, at, counts = np.unique(labels, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(counts[at] < LEAF)
    for rows, label in [(np.flatnonzero(at == v), values[v]) for v in np.flatnonzero(counts >= LEAF)] + [(mixed, None)]:
        if len(rows):
            q, i, n = p[rows], ids[rows], labels[rows]
            pruned += BallTree(q, label).search(q, i, n, want, everything)
    return pruned


def numbers(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; shorter rows are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    return out


def whole(column: pa.Array) -> np.ndarray:
    """An Arrow column as integers where it has no nulls and is one of integers, else as objects."""
    if column.null_count == 0 and pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def labelled(vectors: DataFrame, label: str = "label", embedding: str = "embedding", vec_id: str = "vec_id", unit: int = 256) -> DataFrame:
    """(vec_id, label, v array<double>): each component x as floor(unit * x). Rows are left out where the label or the
    vector is null, or a component is null, a NaN or an infinity."""
    rows = vectors.where(F.col(label).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.struct(F.col(vec_id).alias("id"), F.col(label).cast("long").alias("label")).alias("key"), F.col(embedding).alias("embedding"))
    return topk.integers(rows, "embedding", "key", unit).select("vec_id.id", "vec_id.label", "v").withColumnRenamed("id", "vec_id")


def window_of(score: int, least: int, most: int) -> tuple[float, float]:
    """Bounds of the whole scores n with least * score <= 100 * n <= most * score."""
    return float(-(-least * score // 100)), float(most * score // 100)


def _block_search(rows: DataFrame, want: Wanted, dims: int, kind: str) -> DataFrame:
    """(search int, vec_id, score): the k best that each partition of rows has for each search."""
    shared = rows.sparkSession.sparkContext.broadcast(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        want = Wanted(want.ids, want.labels, want.vectors, want.of, want.low, want.high, want.floor, want.k, want.same_label)
        held, size, kind = [], 0, None

        def look(part: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([whole(b.column(0)) for b in part])
            labels = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in part])
            search_chunk(np.concatenate([numbers(b.column(2), dims) for b in part]), ids, labels, want)

        for b in batches:
            kind = b.schema.field(0).type
            for s in range(0, len(b), CHUNK):
                held.append(b.slice(s, CHUNK))
                size += len(held[-1])
                if size >= CHUNK:
                    look(held)
                    held, size = [], 0
        if held:
            look(held)
        found = [(n, i, s) for n, best in enumerate(want.found) for s, i in best]
        for s in range(0, len(found), 65_536):
            cols = list(zip(*found[s : s + 65_536], strict=True))
            ids = [None if i is None else i.item() if isinstance(i, np.generic) else i for i in cols[1]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(ids, kind), pa.array(cols[2], pa.int64())], names=["search", "vec_id", "score"])

    return rows.mapInArrow(run, f"search int, vec_id {kind}, score long")


def _first_look(want: Wanted, lead: tuple) -> None:
    """Floors that the k-th best of each search reaches at least: k of the lead rows have that score or more."""
    ids, labels, p = lead
    for s in range(0, len(ids), LEAF):
        verify(p[s : s + LEAF], ids[s : s + LEAF], labels[s : s + LEAF], want, np.arange(len(want.of)))
    want.found = []


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("search").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for labelled() rows and anchors.

    An anchor's positives are the best other rows of its label. For each of them come the best rows of other labels whose
    score is between least and most percent of the positive's. Higher scores come first, ties by the smaller id, null ids
    last. A row with the anchor's own id is neither; of anchors that share an id the one of the smallest label and vector
    counts, and anchors of a null id are left out. Other rows that share an id each take a place. Vectors of unequal
    length are filled up with zeros. A negative positive score leaves no window. Empty tables give an empty result.

    A block of anchors, bounded by ANCHOR_BLOCK and ANCHOR_BYTES, goes through the driver to the tasks at a time, and its
    answers are written before the next one is fetched. A partition returns as many rows a search as are wanted.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    # By label, so that most trees are of one; within a label by a hash, so that a frequent label is split.
    rows = materialize(rows.repartitionByRange("label", F.xxhash64("vec_id", "v")), "by-label")
    asked = anchors.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("first"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = min(ANCHOR_BLOCK, max(1, ANCHOR_BYTES // max(1, 8 * dims)))
    blocks = max(1, math.ceil(asked.count() / size))
    asked = materialize(asked.select("vec_id", "first.*", F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks - 1)).cast("int").alias("block")), "anchors")
    lead = _arrays(rows.limit(FIRST).collect(), dims)
    paths, out = [], None
    for block in range(2 * blocks - 1):
        ids, labels, q = _arrays(asked.where(F.col("block") == block).select("vec_id", "label", "v").collect(), dims)
        if not len(ids):
            continue
        n = len(ids)
        free = np.full(n, -np.inf)
        want = Wanted(ids, labels, q, np.arange(n), free, -free, free, positives, True)
        _first_look(want, lead)
        near = materialize(_best(_block_search(rows, want, dims, kind), positives), "positives").collect()
        if not near:
            continue
        near.sort(key=lambda r: (r["search"], r["rank"]))
        bounds = np.array([window_of(r["score"], least, most) for r in near])
        of, floor = np.array([r["search"] for r in near]), np.full(len(near), -np.inf)
        want = Wanted(ids, labels, q, of, bounds[:, 0], bounds[:, 1], floor, negatives, False)
        _first_look(want, lead)
        found = _best(_block_search(rows, want, dims, kind), negatives)
        pairs = spark.createDataFrame(
            [(k, _plain(ids[r["search"]]), r["vec_id"], r["score"]) for k, r in enumerate(near)], f"search int, anchor_id {kind}, positive_id {kind}, positive_score long"
        )
        out = found.join(F.broadcast(pairs), "search").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        paths.append(materialize(out, "negatives")._materialized_path)
    return spark.read.schema(out.schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def _arrays(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = whole(pa.array([r[0] for r in rows])) if rows else np.array([], np.int64)
    return ids, np.array([r[1] for r in rows], np.int64), topk.matrix([r[2] for r in rows], dims)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = labelled(vectors.select("vec_id", label.alias("label"), "embedding"))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
