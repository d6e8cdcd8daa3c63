"""Deterministic clusters of papers inside regions, their places, names and assets.

The choices depend on the groups as they grow, so a region is clustered as a whole, in applyInPandas. A region with
more papers than MOST_PAPERS, or more different lists of tags than MOST_KINDS, is refused: papers are compared by their
tags, a list with each other once, and such a region is to be partitioned first.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V
from scriptoria.functions.scalar import ORBIT_RATIO, RING_CAPACITY, RING_DEPTH, RING_RADIUS, SEPARATION, display_state, fnv1a, ring_index, target_clusters
from scriptoria.functions.normal import once
from scriptoria.operators.aggregates import corpus_fingerprint
from scriptoria.operators.joins import at_most

MOST_PAPERS, MOST_KINDS = 50_000, 5_000
MOST_CLUSTERS = 12
MOST_REGIONS = 10


def hash32(text: str) -> int:
    """FNV-1a over UTF-16 units, as functions.scalar.fnv1a() computes for characters of the basic plane."""
    h = 2166136261
    units = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def routing_weights(relations: DataFrame) -> DataFrame:
    """(a, b, w): the largest routing weight of each unordered pair."""
    state = display_state(F.col("status"), F.col("strength"), F.col("confidence"), F.col("formalEligible"))
    w = F.create_map(*(F.lit(x) for pair in V.ROUTING_WEIGHTS.items() for x in pair))[state]
    return relations.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))


class Region:
    """A region's papers, how near they are to each other, and how they are put into groups (seed to members)."""

    def __init__(self, region, tags: dict, links: dict, seed: str):
        self.region, self.tags, self.links, self.seed = region, tags, links, seed
        self.rank = {p: (hash32(f"{seed}\0{region}\0anchor\0{p}"), p) for p in tags}

    def affinity(self, x, y) -> float:
        return 1.0 if x == y else self.likeness(x, y, self.links.get((min(x, y), max(x, y)), 0.0))

    def likeness(self, x, y, link: float = 0.0) -> float:
        """How close the tags of two papers are, which may be one, beside a relation of this weight."""
        union = len(self.tags[x] | self.tags[y])
        shared = len(self.tags[x] & self.tags[y]) / union if union else 0.0
        return min(1.0, shared * V.TAG_SHARE + link * V.RELATION_SHARE)

    def target(self) -> int:
        n = len(self.tags)
        return 0 if not n else 1 if n <= 3 else min(MOST_CLUSTERS, max(2, math.ceil(n / 5)))

    def found(self, groups: dict, free: set, count: int) -> None:
        """Groups up to count: each is founded by the free paper that is farthest from all seeds. Where none is free,
        the largest group of three or more gives up its paper of the lowest rank, but never its seed."""
        near = {p: max((self.affinity(p, g) for g in groups), default=0.0) for p in free}
        while len(groups) < count:
            if not free:
                donor = self.largest(groups)
                if donor is None:
                    return
                moved = min((p for p in groups[donor] if p != donor), key=self.rank.get)
                groups[donor].remove(moved)
                free.add(moved)
                near[moved] = max(self.affinity(moved, g) for g in groups)
            anchor = min(free, key=lambda p: (near[p], self.rank[p]))
            free.remove(anchor)
            groups[anchor] = [anchor]
            for p in free:
                near[p] = max(near[p], self.affinity(p, anchor))

    def largest(self, groups: dict, but=None):
        """The seed of the largest group of three or more, ties by seed; None if there is none."""
        able = [g for g, members in groups.items() if len(members) > 2 and g != but]
        return min(able, key=lambda g: (-len(groups[g]), g), default=None)

    def join(self, groups: dict, free: set, lone_first: bool) -> None:
        """Every free paper, by id, joins the group with the closest member; groups of one come first if asked for."""
        kinds = {}  # papers with the same tags are equally close to each other paper that no relation links
        kind = {p: kinds.setdefault(frozenset(t), p) for p, t in self.tags.items()}
        close = {k: dict.fromkeys(groups, 0.0) for k in kinds.values()}
        seen, linked = {g: set() for g in groups}, {}
        for a, b in self.links:
            linked.setdefault(a, []).append(b)
            linked.setdefault(b, []).append(a)
        group_of = {}

        def add(p, g):
            group_of[p] = g
            if kind[p] not in seen[g]:
                seen[g].add(kind[p])
                for k in close:
                    close[k][g] = max(close[k][g], self.likeness(k, kind[p]))

        for g, members in groups.items():
            for m in members:
                add(m, g)
        for p in sorted(free):
            near = dict(close[kind[p]])
            for m in linked.get(p, ()):
                if m in group_of:
                    near[group_of[m]] = max(near[group_of[m]], self.affinity(p, m))
            g = min(groups, key=lambda g: (lone_first and len(groups[g]) > 1, -near[g], len(groups[g]), hash32(f"{self.seed}\0{p}\0{g}"), g))
            groups[g].append(p)
            add(p, g)

    def fresh(self) -> dict:
        """Groups from nothing: seeds farthest first from a hash-ranked start, then a companion for each, then the rest."""
        groups, free = {}, set(self.tags)
        self.found(groups, free, self.target())
        if len(groups) > 1:
            for g in groups:
                if free:
                    companion = min(free, key=lambda p: (-self.affinity(p, g), self.rank[p]))
                    free.remove(companion)
                    groups[g].append(companion)
        self.join(groups, free, False)
        return groups

    def kept(self, before: dict, gone: bool) -> dict:
        """Groups of earlier assignments (paper to seed), brought up to the papers that there are now.

        Groups whose seed is still a member stay, up to the most; papers of others are free. New groups are founded up
        to the target, free papers join, and a group of one gets the closest paper of the largest group that has three.
        A region that has lost a paper (gone) or has no group that stays is grouped afresh.
        """
        seeds = sorted({g for g in before.values() if before.get(g) == g})[:MOST_CLUSTERS]
        if gone or not seeds:
            return self.fresh()
        groups = {g: sorted(p for p, own in before.items() if own == g) for g in seeds}
        free = set(self.tags) - {p for members in groups.values() for p in members}
        self.found(groups, free, max(len(groups), self.target()))
        self.join(groups, free, True)
        for lone in [g for g, members in groups.items() if len(members) == 1]:
            donor = self.largest(groups, lone)
            if donor is not None:
                companion = min((p for p in groups[donor] if p != donor), key=lambda p: (-self.affinity(p, lone), p))
                groups[donor].remove(companion)
                groups[lone].append(companion)
        return groups


def _grouped(rows: DataFrame, papers: DataFrame, relations: DataFrame, seed: str) -> DataFrame:
    """rows (regionId, paperId, tags, present, known, before), a region a group, beside the links within the region."""
    weights = routing_weights(relations)
    near = papers.select("paperId", "regionId")
    own = weights.join(near.withColumnsRenamed({"paperId": "a", "regionId": "ra"}), "a").join(near.withColumnsRenamed({"paperId": "b", "regionId": "rb"}), "b").where("ra = rb")
    edges = own.select(F.col("ra").alias("regionId"), "a", "b", "w")

    def run(key: tuple, group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        here = group[group["present"]]
        if len(here) > MOST_PAPERS:
            raise ValueError(f"region {key[0]} has {len(here)} papers; partition it first")
        tags = {p: set(t) if t is not None else set() for p, t in zip(here["paperId"], here["tags"], strict=True)}
        if len(kinds := set(map(frozenset, tags.values()))) > MOST_KINDS:
            raise ValueError(f"region {key[0]} has {len(kinds)} lists of tags; partition it first")
        region = Region(key[0], tags, {(a, b): w for a, b, w in zip(links["a"], links["b"], links["w"], strict=True)}, seed)
        had = here[here["known"]]
        groups = region.kept(dict(zip(had["paperId"], had["before"], strict=True)), len(here) < len(group))
        return pd.DataFrame([(key[0], p, g) for g, members in groups.items() for p in members], columns=["regionId", "paperId", "clusterSeed"])

    kind = dict(rows.dtypes)
    schema = f"regionId {kind['regionId']}, paperId {kind['paperId']}, clusterSeed {kind['paperId']}"
    return rows.groupBy("regionId").cogroup(edges.groupBy("regionId")).applyInPandas(run, schema)


def clusters(papers: DataFrame, relations: DataFrame, seed: str = "seed") -> DataFrame:
    """(regionId, paperId, clusterSeed): papers (regionId, paperId, tags array) in clusters named by their seed.

    Seeds are chosen farthest first from a hash-ranked start, each gets its closest companion, and every other paper,
    by id, joins the cluster with the closest member; ties go to the smaller cluster, then by hash.
    """
    rows = papers.select("regionId", "paperId", F.array_distinct("tags").alias("tags"), F.lit(True).alias("present"), F.lit(False).alias("known"), F.col("paperId").alias("before"))
    return _grouped(rows, papers, relations, seed)


def grown(previous: DataFrame, papers: DataFrame, relations: DataFrame, seed: str = "seed") -> DataFrame:
    """(regionId, paperId, clusterSeed) from earlier clusters (the same columns): Region.kept() says what stays."""
    old = previous.select("regionId", "paperId", "clusterSeed")
    new = papers.select("regionId", "paperId", F.array_distinct("tags").alias("tags"), F.lit(True).alias("present"))
    both = new.join(old, ["regionId", "paperId"], "full_outer")
    rows = both.select("regionId", "paperId", "tags", F.coalesce("present", F.lit(False)).alias("present"), F.col("clusterSeed").isNotNull().alias("known"), F.coalesce("clusterSeed", "paperId").alias("before"))
    return _grouped(rows, papers, relations, seed)


def orbit_slots(region: Column, center: Column, seed: str) -> Column:
    """The slots of a region's two rings, array<struct<ring, slot, position>>: evenly spaced from a phase that the region's
    id gives, the outer ring shifted by half a slot."""
    phase = lambda what: fnv1a(F.concat(F.lit(f"{seed}\0"), region.cast("string"), F.lit(f"\0{what}"))) / F.lit(4294967295.0)
    out = []
    for ring, capacity in enumerate(RING_CAPACITY):
        for slot in range(capacity):
            turn = (math.pi / capacity if ring else 0.0) + slot / capacity * 2 * math.pi
            angle = phase("orbit-phase") * 2 * math.pi + F.lit(turn)
            depth = F.sin(angle * 2 + phase("depth-phase") * 2 * math.pi) * RING_DEPTH[ring]
            at = (center[0] + F.cos(angle) * RING_RADIUS[ring], center[1] + F.sin(angle) * RING_RADIUS[ring] * ORBIT_RATIO, center[2] + depth)
            out.append(F.struct(F.lit(ring).alias("ring"), F.lit(slot).alias("slot"), F.array(*(F.round(x, 6) for x in at)).alias("position")))
    return F.array(*out)


def _apart(a: Column, b: Column) -> Column:
    return sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)), F.lit(0.0))


def places(seeds: DataFrame, regions: DataFrame, seed: str = "seed", earlier: DataFrame | None = None) -> DataFrame:
    """(regionId, clusterSeed, ring, slot, position) of every cluster.

    Clusters of earlier (regionId, clusterSeed, position) that are still there keep their position. The others, in order of
    their seed, take the first ring that has room and on it the free slot that is farthest from all that are placed, the
    lower one of equals; slot is null for a kept position that is no slot's. A cluster that no slot holds without touching
    another has no ring and no position. A region has as many clusters as its rings have slots at most.
    """
    kept = seeds.select("regionId", "clusterSeed", F.lit(None).cast("array<double>").alias("position")) if earlier is None else seeds.select("regionId", "clusterSeed").join(earlier.select("regionId", "clusterSeed", "position"), ["regionId", "clusterSeed"], "left")
    one = F.struct("clusterSeed", "position")
    per = kept.groupBy("regionId").agg(
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), one))).alias("held"), F.array_sort(F.collect_list(F.when(F.col("position").isNull(), F.col("clusterSeed")))).alias("fresh")
    ).join(regions.select("regionId", "center"), "regionId")
    per = per.withColumn("slots", orbit_slots(F.col("regionId"), F.col("center"), seed))
    kind = f"array<struct<clusterSeed:{dict(seeds.dtypes)['clusterSeed']},ring:int,slot:int,position:array<double>>>"
    slot_of = lambda position: F.try_element_at(F.filter("slots", lambda s: _apart(s["position"], position) < 1e-10), F.lit(1))
    begin = F.transform("held", lambda h: F.struct(h["clusterSeed"].alias("clusterSeed"), ring_index(h["position"], F.col("center")).alias("ring"), slot_of(h["position"])["slot"].alias("slot"), h["position"].alias("position"))).cast(kind)

    def place(occupied: Column, name: Column) -> Column:
        here = F.filter(occupied, lambda o: o["position"].isNotNull())
        room = F.array_compact(F.array(*(F.when(F.size(F.filter(here, lambda o, r=r: o["ring"] == r)) < n, r) for r, n in enumerate(RING_CAPACITY))))
        far = lambda s: F.coalesce(F.array_min(F.transform(here, lambda o: F.round(_apart(s["position"], o["position"]), 9))), F.lit(1e18))
        free = F.transform(F.filter("slots", lambda s: F.array_contains(room, s["ring"]) & (far(s) >= 1e-10)), lambda s: F.struct(s["ring"].alias("ring"), (-far(s)).alias("near"), s["slot"].alias("slot"), s["position"].alias("position")))
        # The first of the sort is the first ring with a free slot, and its widest.
        return once(F.try_element_at(F.array_sort(free), F.lit(1)), lambda s: F.concat(occupied, F.array(
            F.struct(name.alias("clusterSeed"), *(F.when(-s["near"] >= SEPARATION**2, s[c]).alias(c) for c in ("ring", "slot", "position"))),
        ).cast(kind)))

    done = per.select("regionId", F.explode(F.aggregate("fresh", begin, place)).alias("p"))
    return done.select("regionId", "p.*")


def assignment_hash(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(assignmentSha256) of a hierarchy, one row: which papers each cluster has and where it stands. Clusters are hashed
    by themselves, and a region's by its clusters' hashes in order, so no task holds more than a region's few."""
    papers = members.groupBy("regionId", "clusterSeed", "paperId").agg(F.count("*").alias("n")).select("regionId", "clusterSeed", F.sha2(F.concat_ws("\0", F.col("paperId").cast("string"), F.col("n").cast("string")), 256).alias("h"))
    # A sum of two parts of each paper's hash stands for the set, and is added up where the papers are.
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = papers.groupBy("regionId", "clusterSeed").agg(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)).alias("papers"))
    rows = placed.join(sums, ["regionId", "clusterSeed"], "left")
    line = F.concat_ws("\0", F.col("clusterSeed").cast("string"), F.coalesce("papers", F.lit("")), F.to_json("position"))
    regions = rows.groupBy("regionId").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    return corpus_fingerprint(regions).withColumnRenamed("fingerprint", "assignmentSha256")


def assets(seeds: DataFrame, names: list[str], seed: str = "seed") -> DataFrame:
    """(regionId, clusterSeed, assetId): every asset as often as any other, give or take one.

    seeds may have an assetId from before. Assets used most before, then those first in hash order, get the odd places.
    A cluster, in order of region and seed, keeps its asset while that has places; the others take the places that are
    left: those of the assets used least first, in hash order. Windows run over clusters, a dozen a region.
    """
    if not names:
        raise ValueError("no assets")
    spark = seeds.sparkSession
    ordered = sorted(set(names), key=lambda a: (hash32(f"{seed}\0asset\0{a}"), a))
    every = F.broadcast(spark.createDataFrame(list(enumerate(ordered)), "o int, assetId string"))  # as many rows as names
    had = F.col("assetId") if "assetId" in seeds.columns else F.lit(None).cast("string")
    rows = seeds.select("regionId", "clusterSeed", had.alias("assetId")).distinct()
    used = every.join(rows.groupBy("assetId").agg(F.count("*").alias("had")), "assetId", "left").fillna(0, ["had"])
    total = rows.agg(F.count("*").alias("n"))
    odd = F.row_number().over(Window.orderBy(F.desc("had"), "o"))
    quota = F.floor(F.col("n") / len(ordered)) + (odd <= F.col("n") % len(ordered)).cast("int")
    quotas = used.crossJoin(F.broadcast(total)).select("assetId", "o", quota.alias("quota"), F.least("had", quota).alias("taken"))
    turn = F.row_number().over(Window.partitionBy("assetId").orderBy("regionId", "clusterSeed"))
    keep = rows.withColumn("turn", turn).join(quotas, "assetId").where("turn <= quota").select("regionId", "clusterSeed", "assetId")
    rest = rows.join(keep, ["regionId", "clusterSeed"], "left_anti").select("regionId", "clusterSeed", F.row_number().over(Window.orderBy("regionId", "clusterSeed")).alias("k"))
    places_left = quotas.where("taken < quota").select("assetId", "o", F.explode(F.sequence("taken", F.col("quota") - 1)).alias("level"))
    places_left = places_left.select("assetId", F.row_number().over(Window.orderBy("level", "o")).alias("k"))
    return keep.unionByName(rest.join(places_left, "k").select("regionId", "clusterSeed", "assetId"))


def region_assets(regions: DataFrame, names: list[str], enabled: list[str] | None = None, seed: str = "seed") -> DataFrame:
    """(regionId, assetId): regions (regionId, assetId or null, place) keep a known asset; each other region, by place
    and id, takes of the enabled assets that are used least so far the one of the lowest hash, null if none is enabled.
    The choice is sequential; more than MOST_REGIONS regions are an error."""
    open_ = sorted(set(names if enabled is None else enabled))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = group["assetId"].isin(names)
        uses = {a: int((group["assetId"][known] == a).sum()) for a in open_}
        out = list(zip(group["regionId"][known], group["assetId"][known], strict=True))
        for region in group[~known].sort_values(["place", "regionId"])["regionId"]:
            pick = min(open_, key=lambda a: (uses[a], hash32(f"{seed}:{region}:{a}"), a), default=None)
            if pick is not None:
                uses[pick] += 1
            out.append((region, pick))
        return pd.DataFrame(out, columns=["regionId", "assetId"])

    rows = at_most(regions.select("regionId", F.col("assetId").cast("string").alias("assetId"), "place"), MOST_REGIONS, "regions")
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: run(pdf), f"regionId {dict(regions.dtypes)['regionId']}, assetId string")


def inspect(members: DataFrame, papers: DataFrame, placed: DataFrame, regions: DataFrame) -> DataFrame:
    """(code, id) of what is wrong with a hierarchy: papers without a cluster or outside their region, empty or badly
    placed clusters, rings over capacity, clusters that touch, too many or too few of them."""
    orphan = papers.select("paperId").join(members, "paperId", "left_anti").select(F.lit("orphan_paper").alias("code"), F.col("paperId").cast("string").alias("id"))
    cross = members.join(papers.select("paperId", F.col("regionId").alias("own")), "paperId").where("own <> regionId").select(F.lit("cross_region").alias("code"), F.col("paperId").cast("string").alias("id"))
    empty = placed.join(members, "clusterSeed", "left_anti").select(F.lit("empty_cluster").alias("code"), F.col("clusterSeed").cast("string").alias("id"))
    at = placed.join(regions.select("regionId", "center"), "regionId").withColumn("found", ring_index(F.col("position"), F.col("center")))
    ring = at.where("found <> ring").select(F.lit("off_ring").alias("code"), F.col("clusterSeed").cast("string").alias("id"))
    full = placed.groupBy("regionId", "ring").count().where((F.col("count") > F.when(F.col("ring") == 0, RING_CAPACITY[0]).otherwise(RING_CAPACITY[1])))
    over = full.select(F.lit("ring_over_capacity").alias("code"), F.col("regionId").cast("string").alias("id"))
    a, b = placed.alias("a"), placed.alias("b")  # twelve clusters a region at most
    pairs = a.join(b, (F.col("a.regionId") == F.col("b.regionId")) & (F.col("a.clusterSeed") < F.col("b.clusterSeed")))
    d = sum((F.pow(F.col("a.position")[k] - F.col("b.position")[k], F.lit(2.0)) for k in range(3)), F.lit(0.0))
    touch = pairs.where(d < SEPARATION**2).select(F.lit("collision").alias("code"), F.col("a.clusterSeed").cast("string").alias("id"))
    wrong = members.groupBy("regionId").agg(F.count("*").alias("papers"), F.count_distinct("clusterSeed").alias("n")).where(F.col("n") > target_clusters(F.col("papers")))
    many = wrong.select(F.lit("too_many_clusters").alias("code"), F.col("regionId").cast("string").alias("id"))
    out = orphan
    for part in (cross, empty, ring, over, touch, many):
        out = out.unionByName(part)
    return out
