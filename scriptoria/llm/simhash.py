"""Near-duplicates by SimHash fingerprints, found with vantage-point trees.

A fingerprint is one long. Equal fingerprints fall together first, in an ordinary aggregation, so copies never meet
as pairs. The distinct fingerprints are partitioned by a vantage-point tree: a node sends those within its radius of
the vantage fingerprint one way and the rest the other way. By the triangle inequality a fingerprint within `d` of
the border may have partners across it; it visits the near side as a guest, so each pair meets in one leaf at least
and no leaf needs to know another. The tree's shape is fitted on a bounded sample; every fingerprint is routed.

A leaf with many rows is tiled: its rows are dealt into blocks, and pairs of blocks are separate groups, so no task
holds more than two blocks. In a group the search goes on with local vantage points: members are split into shells by
their exact distance to a vantage point, and a shell is compared only with the shells that the triangle bound leaves.
Each group returns a spanning forest of the links that it found (a row a fingerprint at most), never all its pairs.
Connected components over the forests finish the grouping.

similar_documents() groups texts by the Jaccard similarity of their shingles: fingerprints of their words propose pairs,
which are found by the same tree and compared exactly, and an exact join of shingle sets finds what they leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.graph import connected_components
from scriptoria.llm.shared import discard, materialize, prepare, small, table

#: Fingerprints that a leaf aims at, and rows of one block of a tiled leaf.
LEAF = 32_768
BLOCK = 65_536
#: Fingerprints at most that shape the tree, and its greatest depth.
SAMPLE = 65_536
MAX_DEPTH = 14
#: Texts at most (about) that say which shingles are common, and how many of these are told apart. Both decide about
#: work only, never about a result.
SAMPLED, COMMON = 16_384, 65_536
#: Sets of a cell whose pairs are counted one by one; shingles of a tile of a larger cell.
FEW, TILE = 16, 1 << 21
#: Bitmaps of a tile of a cell.
BITMAPS = 1 << 14
#: Sets asked for, two longs each, up to which their list is broadcast and no text is shuffled.
ASKED = 500_000
#: Bits in which the fingerprints of two texts' words may differ that are proposed as similar.
PROPOSED = 3
#: Pairs compared in one vectorised step.
STEP = 1 << 18


def fingerprint_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased (A-Z) words, in order and with repeats; empty for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(x, 42) for x in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))]
    return np.array(hashes, np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> tuple[int, np.ndarray]:
    """SimHash of the shingles' hashes, and these; (0, empty) for a text without words."""
    h = fingerprint_hashes(text, shingle)
    return simhash(h), h


def simhash(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        part = h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, n int) for every row; n is the number of shingles.

    Null and wordless texts have fingerprint 0 and n 0. A text is read whole, of any length.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ns = [], []
            for t in b.column(1):
                f, h = fingerprint(t.as_py(), shingle)
                fps.append(f)
                ns.append(len(h))
            cols = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ns, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "n"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, n int")


class Tree:
    """A vantage-point tree over 64-bit fingerprints as arrays; node k has children 2k+1 (near) and 2k+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int):
        self.depth, self.reach = depth, reach
        self.vantage = np.zeros(max(1, 2**depth - 1), np.uint64)
        self.radius = np.full(len(self.vantage), 32, np.int64)
        rng, parts = np.random.default_rng(7), [sample]
        for level in range(depth):
            below = []
            for k, part in enumerate(parts):
                node = 2**level - 1 + k
                if len(part):
                    self.vantage[node] = part[rng.integers(len(part))]
                    d = np.bitwise_count(part ^ self.vantage[node]).astype(np.int64)
                    self.radius[node] = np.median(d)
                    below += [part[d <= self.radius[node]], part[d > self.radius[node]]]
                else:
                    below += [part, part]
            parts = below

    def route(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) for each leaf that each fingerprint visits; exactly one visit a row is home."""
        row, node, home = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(fp[row] ^ self.vantage[node]).astype(np.int64)
            r = self.radius[node]
            near = d <= r
            # A home row beyond the border visits the near side as a guest; its partners there never visit back.
            # A guest looks for home rows only, on either side.
            go_near = near | (d - self.reach <= r)
            go_far = np.where(home, ~near, d + self.reach > r)
            row, node, home = (
                np.concatenate([row[go_near], row[go_far]]),
                np.concatenate([2 * node[go_near] + 1, 2 * node[go_far] + 2]),
                np.concatenate([(home & near)[go_near], home[go_far]]),
            )
        return row, node - (2**self.depth - 1), home


def _find(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def link(fp: np.ndarray, home: np.ndarray, reach: int, pairs: list | None = None) -> np.ndarray:
    """Component labels (the index of a member) of rows linked at `reach` or fewer bits, a home row in each pair.

    A list given as pairs takes the links that connect them, one less than a component has members.
    """
    n = len(fp)
    parent = np.arange(n)
    stack = [(np.flatnonzero(home), np.arange(n), 0)]
    while stack:
        a, b, level = stack.pop()
        if len(a) * len(b) > STEP and level < 8:
            v = fp[a[(level * 7919) % len(a)]]
            da, db = np.bitwise_count(fp[a] ^ v).astype(np.int64), np.bitwise_count(fp[b] ^ v).astype(np.int64)
            order = np.argsort(db, kind="stable")
            b, db = b[order], db[order]
            parts = []
            for s in np.unique(da):
                near = b[np.searchsorted(db, s - reach) : np.searchsorted(db, s + reach, "right")]
                parts.append((a[da == s], near, level + 1))
            if sum(len(x) * len(y) for x, y, _ in parts) < 0.9 * len(a) * len(b):
                stack += [p for p in parts if len(p[1])]
                continue
        rows = max(1, STEP // max(1, len(b)))
        for k in range(0, len(a), rows):
            part = a[k : k + rows]
            i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= reach)
            i, j = part[i], b[j]
            new = parent[i] != parent[j]
            i, j = i[new], j[new]
            if len(i):
                for one, other in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = _find(parent, one), _find(parent, other)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        if pairs is not None:
                            pairs.append((one, other))
                while (parent != parent[parent]).any():
                    parent = parent[parent]
    return parent


def _forests(placed: DataFrame, reach: int, direct: bool = False) -> DataFrame:
    """(src, dst) spanning edges between keys; placed has cell, key, fp, home, a row a visit. An edge leads to its
    component's first member or, if direct, is a link itself.

    Rows of a cell are dealt into tiles by a hash of the key; each pair of tiles is a group of its own.
    """
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tiles"))
    counts = small(materialize(counts, "cells"))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    dealt = placed.join(counts, "cell").withColumn("tile", tile)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("t1", F.least("tile", "other")).withColumn("t2", F.greatest("tile", "other")).drop("tiles", "tile", "other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        key, fp = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        pairs = [] if direct else None
        parent = link(fp, pdf["home"].to_numpy(bool), reach, pairs)
        if direct:
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            return pd.DataFrame({"src": key[i], "dst": key[j]})
        linked = parent != np.arange(len(parent))
        out = pd.DataFrame({"src": key[linked], "dst": key[parent[linked]]})
        return out[out["src"] != out["dst"]]

    return dealt.groupBy("cell", "t1", "t2").applyInPandas(run, "src long, dst long")


def components(distinct: DataFrame, reach: int = 2, leaf: int = LEAF) -> DataFrame:
    """(node, root) for the distinct fingerprints (column fp) that have a link; others are missing."""
    return connected_components(fingerprint_links(distinct, reach, leaf))


def fingerprint_links(distinct: DataFrame, reach: int, leaf: int = LEAF, direct: bool = False) -> DataFrame:
    """(src, dst) edges that span the groups of each leaf of a vantage-point tree over distinct fingerprints."""
    spark = distinct.sparkSession
    prepare(spark)
    n = distinct.count()
    depth = 0
    while depth < MAX_DEPTH and n > leaf * 2**depth:
        depth += 1
    sample = np.empty(0, np.uint64)
    if depth:
        share = min(1.0, SAMPLE / 2 / n)
        picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= int(share * (1 << 30))).limit(SAMPLE)
        sample = np.sort(np.array([r[0] for r in picked.collect()], np.int64).view(np.uint64))
    tree = spark.sparkContext.broadcast(Tree(sample, depth, reach))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, cell, home = tree.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(fp[row]), pa.array(fp[row]), pa.array(home)], names=["cell", "key", "fp", "home"]
            )

    placed = distinct.select("fp").mapInArrow(place, "cell long, key long, fp long, home boolean")
    return materialize(_forests(materialize(placed, "visits"), reach, direct), "links")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row: fingerprints link at `reach` or fewer differing bits.

    component_id is the smallest doc_id reachable over links, the row's own included. Rows that share a doc_id keep
    a row each. A null doc_id is in a component like any other but never names it unless it has no other member.
    Null, empty and wordless texts share fingerprint 0, which links like any other. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    rows = materialize(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    nodes = components(classes.select("fp"), reach)
    rooted = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of lower-cased (A-Z) words: hashes of its words, combined
    by place. A text of fewer words is one shingle; one without words has none."""
    return shingles_of(word_hashes(text), shingle)


def word_hashes(text: bytes | None) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, (text or b"").lower().split())), np.uint64)


def shingles_of(h: np.ndarray, shingle: int) -> np.ndarray:
    out = np.full(min(len(h), max(1, len(h) - shingle + 1)), min(len(h), shingle), np.uint64)
    for k in range(min(len(h), shingle)):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two non-empty sets, as sorted arrays."""
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first hashes of a set in an order that all sets share: those not in `common` (sorted), then by how `often`.

    Sets of this similarity share a hash of their prefixes whatever the order is, so the order decides about work only.
    """
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    weight = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        weight = np.where(common[at] == h, often[at], 0)
    return h[np.lexsort((h, weight))[:n]]


def bitmap_words(n: int) -> int:
    """Longs in the bitmap of a set of n members."""
    return 1 << max(2, min(8, n.bit_length() - 6))


def bitmap(h: np.ndarray, words: int) -> np.ndarray:
    """Bits of which each member of a set flips one; of half as many words it is the halves of this one, combined by XOR."""
    low, bits = h.astype(np.uint64), np.zeros(words, np.uint64)
    np.bitwise_xor.at(bits, ((low >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (low & np.uint64(63)))
    return bits


def apart(n: np.ndarray, label: np.ndarray, bits: list[np.ndarray], similarity: float) -> tuple[np.ndarray, list]:
    """(which sets may be similar to one of another label, as far as sizes and bitmaps say, pairs of these that connect
    the labels, the likeliest first). Bitmaps are of bitmap_words; a set is held against those of similar sizes in as many
    words as the least of them has, whatever smaller sets there are."""
    order, out, pairs, parent = np.argsort(n, kind="stable"), np.zeros(len(n), bool), [], np.unique(label, return_inverse=True)[1]
    sizes, bits, kind, folded = n[order], [bits[k] for k in order], parent[order], {}
    words = np.array([len(b) for b in bits])
    for k in range(len(n) - 1):
        near = slice(k + 1, np.searchsorted(sizes, sizes[k] / similarity + 1e-6, "right"))
        if near.start == near.stop or (kind[near] == kind[k]).all():
            continue
        least = int(words[k : near.stop].min())
        if least not in folded:
            enough = words >= least
            folded[least] = np.cumsum(enough) - 1, np.array([np.bitwise_xor.reduce(b.reshape(-1, least), axis=0) for b, x in zip(bits, enough, strict=True) if x])
        at, flat = folded[least]
        differ = np.bitwise_count(flat[at[near]] ^ flat[at[k]]).sum(axis=1, dtype=np.int64)
        both = sizes[near] + sizes[k]
        may = np.flatnonzero((kind[near] != kind[k]) & (differ * (1 + similarity) <= (1 - similarity) * both + 1e-6))
        if len(may):
            out[order[k]] = True
            out[order[near][may]] = True
            # Of the pairs of a set with each label the likeliest will do.
            ranked = may[np.argsort(differ[may] / both[may], kind="stable")]
            best = ranked[np.unique(kind[near][ranked], return_index=True)[1]]
            pairs += zip((differ[best] / both[best]).tolist(), [k] * len(best), (k + 1 + best).tolist(), strict=True)
    parent, chosen = np.arange(len(n)), []
    for _, k, j in sorted(pairs):
        x, y = _find(parent, kind[k]), _find(parent, kind[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.append((int(order[k]), int(order[j])))
    return out, chosen


def same_sets(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> np.ndarray:
    """Component labels (the index of a member) of sets linked at `similarity` or more; with sides, across them only.

    A set's bitmap has a bit flipped for each member, so two bitmaps differ in no more bits than the sets in members:
    pairs that they rule out are not similar. The others are compared exactly unless they are connected already.
    """
    label = np.arange(len(sets))
    if len(sets) == 2:
        if jaccard(*sets) >= similarity:
            label[1] = 0
        return label
    n = np.array([len(x) for x in sets])
    words = bitmap_words(int(n.max()))
    bits = np.array([bitmap(h, words) for h in sets])
    order = np.argsort(n, kind="stable")
    sizes, bits = n[order], bits[order]
    for k, i in enumerate(order[:-1]):
        if not label.any():
            break
        near = k + 1 + np.flatnonzero(label[order[k + 1 : np.searchsorted(sizes, sizes[k] / similarity + 1e-6, "right")]] != label[i])
        if side is not None:
            near = near[side[order[near]] != side[i]]
        j = order[near]
        apart = np.bitwise_count(bits[near] ^ bits[k]).sum(axis=1, dtype=np.int64)
        for x in j[apart * (1 + similarity) <= (1 - similarity) * (n[i] + n[j]) + 1e-6]:
            if label[x] != label[i] and jaccard(sets[i], sets[x]) >= similarity:
                low, high = sorted((label[x], label[i]))
                label[label == high] = low
    return label


def _common(docs: DataFrame, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that several texts of a bounded sample have; they come last in prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["h"])

    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, SAMPLED / max(1, n)) * (1 << 30))).select(F.col("text").cast("binary").alias("text"))
    counts = picked.dropDuplicates().mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


def _candidates(tokens: DataFrame, similarity: float) -> DataFrame:
    """(cell, key, n): sets to be compared with each other, from tokens (token, key, n), the hashes of prefixes.

    Tokens that the same sets have are one cell. Of a cell with few sets each pair counts the tokens it shares in such
    cells: prefixes of sets of sizes a <= b and of this similarity share more than (a + b) s / (1 + s) - s b. Pairs that
    reach it are cells of their own; pairs that share a larger cell meet there whatever they share besides.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    visits = materialize(tokens.join(shared, "token"), "visits")
    lists = visits.groupBy("token").agg(
        F.first("m").alias("m"), F.min("key").alias("a"), F.max("key").alias("z"), F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key")).alias("y")
    )
    cells = materialize(lists.groupBy("m", "a", "z", "x", "y").agg(F.min("token").alias("token"), F.count("*").alias("times")), "cells")
    large = visits.where(F.col("m") > FEW).join(cells.select("token"), "token", "left_semi").select(F.col("token").alias("cell"), "key", "n")
    few = visits.where(F.col("m") <= FEW).join(cells.select("token", "times"), "token").select("token", "key", "n", "times")
    other = few.select("token", F.col("key").alias("key2"), F.col("n").alias("n2"))
    s = F.lit(similarity)
    pairs = few.join(other, "token").where((F.col("key") < F.col("key2")) & (F.least("n", "n2") >= s * F.greatest("n", "n2") - 1e-6))
    pairs = pairs.groupBy("key", "key2").agg(F.sum("times").alias("c"), F.first("n").alias("n"), F.first("n2").alias("n2"))
    pairs = pairs.where(F.col("c") >= (F.col("n") + F.col("n2")) * s / (1 + s) - F.greatest(F.ceil(s * F.col("n") - 1e-9), F.ceil(s * F.col("n2") - 1e-9)) + 1 - 1e-6)
    ends = F.array(F.struct("key", "n"), F.struct(F.col("key2").alias("key"), F.col("n2").alias("n")))
    pairs = pairs.select(F.xxhash64("key", "key2").alias("cell"), F.explode(ends).alias("e")).select("cell", "e.key", "e.n")
    out = materialize(large.unionByName(pairs), "candidates")
    discard(visits)
    discard(cells)
    return out


def _proposed(classes: DataFrame) -> DataFrame:
    """(cell, key, n): classes whose fingerprints are equal, and pairs of those that are linked in the tree's leaves.

    A leaf proposes a pair less than it has fingerprints at most, however many are near each other.
    """
    links = fingerprint_links(classes.select("fp").distinct(), PROPOSED, direct=True)
    same = classes.groupBy("fp").agg(F.min("key").alias("key"), F.min_by("n", "key").alias("n"), F.count("*").alias("m"))
    equal = classes.join(same.where("m > 1").select("fp"), "fp", "left_semi").select(F.xxhash64(F.lit("fp"), "fp").alias("cell"), "key", "n")
    ends = links.select(F.xxhash64(F.lit("pair"), F.least("src", "dst"), F.greatest("src", "dst")).alias("cell"), F.explode(F.array("src", "dst")).alias("fp"))
    return equal.unionByName(ends.distinct().join(same, "fp").select("cell", "key", "n"))


def _unsettled(candidates: DataFrame, known: DataFrame | None, bitmaps: DataFrame, similarity: float, likely: bool = False) -> DataFrame:
    """candidates (cell, key, n) without the sets of a cell that are in one group of known (node, root), if given, with
    all that they may be similar to there. Bitmaps (key, bits) travel, not sets; a cell of many is tiled as in _similar().
    If likely, cells are instead pairs that would connect such sets: a pair less than a cell has sets at most, and cells
    of much the same sets propose the same ones.
    """
    marked = candidates.withColumn("root", F.col("key"))
    if known is not None:
        marked = candidates.join(known.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = marked.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("m")).where("a <> z")
    mixed = mixed.select("cell", F.ceil(F.col("m") / BITMAPS).cast("int").alias("tiles"))
    dealt = marked.join(mixed, "cell").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("cell", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "key", "n", "root").join(bitmaps, "key")
    groups = dealt.repartition("cell", "t1", "t2").sortWithinPartitions("cell", "t1", "t2", "key")

    def open_rows(now: tuple, rows: list) -> Iterator[tuple]:
        if len(rows) > 1:
            keys, ns, roots, bits = zip(*rows, strict=True)
            may, pairs = apart(np.array(ns), np.array(roots), [np.frombuffer(b, "<u8") for b in bits], similarity)
            if likely:
                for pair in pairs:
                    k, j = sorted(pair, key=lambda x: keys[x])
                    cell = xxhash.xxh3_64_intdigest(b"%d %d" % (keys[k], keys[j])) - (1 << 63)
                    yield from ((cell, keys[x], ns[x]) for x in (k, j))
                return
            yield from ((now[0], keys[k], ns[k]) for k in np.flatnonzero(may).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        kinds = [("cell", pa.int64()), ("key", pa.int64()), ("n", pa.int32())]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])
        for b in batches:
            for *group, key, n, root, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != now:
                    out.extend(open_rows(now, rows))
                    now, rows = group, []
                rows.append((key, n, root, bits))
            yield flush()
            out.clear()
        out.extend(open_rows(now, rows))
        yield flush()

    columns = groups.select("cell", "t1", "t2", "key", "n", "root", "bits")
    return columns.mapInArrow(run, "cell long, key long, n int").distinct()


def _similar(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) spanning edges of the candidates that are similar by their exact sets (key, set).

    A cell of many shingles is dealt into tiles by a hash of the key; each pair of tiles is a group of its own.
    """
    tiles = candidates.groupBy("cell").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    dealt = candidates.drop("n").join(small(materialize(tiles, "tiles")), "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("cell", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "key").join(sets, "key")
    groups = dealt.repartition("cell", "t1", "t2").sortWithinPartitions("cell", "t1", "t2", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def close() -> None:
            if len(rows) > 1:
                side = None if now[1] == now[2] else np.array([r[0] for r in rows])
                label = same_sets([np.frombuffer(r[2], "<u4") for r in rows], side, similarity)
                out.extend((rows[k][1], rows[r][1]) for k, r in enumerate(label.tolist()) if k != r)
            rows.clear()

        def flush() -> pa.RecordBatch:
            a = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])

        for b in batches:
            for *group, tile, key, members in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != now:
                    close()
                    now = group
                rows.append((tile, key, members))
            yield flush()
        close()
        yield flush()

    return groups.select("cell", "t1", "t2", "tile", "key", "set").mapInArrow(run, "src long, dst long")


def _sets(docs: DataFrame, classes: DataFrame, cells: DataFrame, whole) -> DataFrame:
    """(key, set) of the classes that cells name; unless they are very many, their list is broadcast and no text is shuffled.
    A row that docs have again may give its set again, once a partition at most."""
    asked = classes.join(cells.select("key").distinct(), "key", "left_semi").select("row", "key")
    asked = materialize(asked, "asked")
    texts = docs.select("row", "text").join(small(asked, ASKED), "row")
    sets = materialize(texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(whole, "key long, set binary"), "sets")
    discard(asked)
    return sets


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id, row, root) for every row: near-duplicates by word shingles at `similarity` or more.

    Two texts link if the Jaccard similarity of their sets of distinct shingles (as hashes, of which 32 bits are
    compared) is `similarity` or more, exactly. SimHash fingerprints of the words propose most of them: those that are
    equal or linked in a leaf of the tree, whose whole sets are compared. A join completes them: sets as similar share a
    shingle of their prefixes, the fifth that comes first in a common order, for 0.8; those that share one are candidates,
    and those that the proposals have not brought together, and that bitmaps of their sets do not tell apart, are
    compared as well. Equal sets fall together before. Components of the links are the groups, so two members of a
    group need not be similar themselves.

    component_id is the smallest doc_id of the group; row is a hash of doc_id and text, root names the group and is
    null for a text without words, which is a group of its own: it has no shingles to be similar by. Null ids as in
    near_duplicates(). An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", row_of().alias("row"))
    hot = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle, similarity))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ns, fps, firsts, bits = [], [], [], [], []
            for t in b.column(2):
                words = word_hashes(t.as_py())
                h = shingles_of(words, shingle)
                fps.append(simhash(words))
                members = np.unique(h.astype("<u4"))
                bits.append(bitmap(members, bitmap_words(len(members))).tobytes())
                keys.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                ns.append(len(h))
                firsts.append(prefix(h, similarity, *hot.value).view(np.int64) if len(h) else h.view(np.int64))
            cols = [b.column(0), b.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(ns, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(firsts, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "key", "n", "fp", "tokens", "bits"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys, sets = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(np.unique(shingle_set(t.as_py(), shingle).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["key", "set"])

    text = F.col("text").cast("binary").alias("text")
    rows = materialize(docs.select("doc_id", "row", text).mapInArrow(starts, f"doc_id {kind}, row long, key long, n int, fp long, tokens array<long>, bits binary"), "prefixes")
    classes = materialize(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min("n").alias("n"), F.min_by("fp", "row").alias("fp")), "classes")
    # By key and row, as the join: a key has one row in classes, and rows that come again need no shuffle of their own.
    heads = rows.join(classes.select("key", "row"), ["key", "row"], "left_semi").dropDuplicates(["key", "row"])
    heads = materialize(heads.select("key", "n", "tokens", "bits"), "heads")
    named_rows = materialize(rows.select("doc_id", "row", "key"), "rows")
    discard(rows)
    bitmaps = heads.select("key", "bits")
    candidates = _candidates(heads.select(F.explode("tokens").alias("token"), "key", "n"), similarity)
    # What SimHash proposes, then what would connect the candidates that it leaves apart, then all that is left of these.
    links = None
    for cells, likely in ((_proposed(classes.select("key", "n", "fp")), False), (candidates, True), (candidates, False)):
        known = None if links is None else connected_components(links)
        asked = materialize(_unsettled(cells, known, bitmaps, similarity, likely), "compared")
        sets = _sets(docs, classes, asked, whole)
        found = materialize(_similar(asked, sets.dropDuplicates(["key"]), similarity), "links")
        discard(sets)
        discard(asked)
        links = found if links is None else links.unionByName(found)
    discard(candidates)
    discard(heads)
    nodes = connected_components(links)
    rooted = classes.join(nodes, classes["key"] == nodes["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("key", "component_id", "root")
    return named_rows.join(named, "key", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), "row", "root")


def row_of():
    """A hash of doc_id and text: what tells rows apart that share an id."""
    return F.xxhash64("doc_id", F.col("text").isNull(), "text")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group of similar_documents(): that of the smallest doc_id, and of the smallest row.

    Rows that share an id but not a group all stay; equal rows without words stay once. Rows of a null id all stay:
    no group can name them.
    """
    known = materialize(groups.where("doc_id is not null").select("doc_id", "row", "root"), "grouped")
    best = known.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("best"))
    gone = known.join(best, "root").where("row <> best.row").select(F.col("row").alias("__row")).distinct()
    again = known.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1").select("__row")
    # What goes is listed and, unless it is very much, broadcast: texts are not shuffled. A null id has no __row.
    kept = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), row_of())).join(small(materialize(gone, "gone"), ASKED), "__row", "left_anti")
    again = materialize(again, "again")
    if not again.isEmpty():
        again = small(again, ASKED)
        plain = [c for c, kind in docs.dtypes if "map<" not in kind]
        once = kept.join(again, "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("d"))
        kept = kept.join(again, "__row", "left_anti").select(*docs.columns).unionByName(once.select("d.*"))
    return kept.select(*docs.columns)


def op5_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, reach=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
