"""Deterministic layout: region centres chosen from sphere points, and papers around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V
from scriptoria.functions.scalar import fnv1a, sphere_point
from scriptoria.operators.joins import at_most

CANDIDATES = 192
#: Regions that best_centres() places at most: each choice depends on all before it.
MOST_REGIONS = 10


def centre_candidates(spark, radius: float = 8.0, count: int = CANDIDATES) -> DataFrame:
    return spark.range(count).select(F.col("id").alias("k"), sphere_point(F.col("id"), F.lit(float(count)), F.lit(radius)).alias("center"))


def region_centres(regions: DataFrame, radius: float = 8.0) -> DataFrame:
    """(regionId, center): regions in hash order on evenly spread sphere points; a row a region, so one window."""
    order = F.row_number().over(Window.orderBy(fnv1a(F.col("regionId").cast("string")), "regionId")) - 1
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return regions.select("regionId", order.alias("k"), n.alias("n")).select("regionId", sphere_point(F.col("k"), F.col("n"), F.lit(radius)).alias("center"))


def rotation(first: int, second: int, angle: float) -> np.ndarray:
    """The matrix that turns the plane of two axes by an angle."""
    m = np.eye(3)
    m[[first, second], [first, second]] = np.cos(angle)
    m[first, second], m[second, first] = -np.sin(angle), np.sin(angle)
    return m


SIZE = np.array(V.VIEWPORT, float)
VIEW = rotation(1, 2, V.CAMERA["rotationX"]) @ rotation(0, 2, V.CAMERA["rotationY"])
PROBES, PROBE_WEIGHTS = np.array(V.FOOTPRINT, float)[:, :2], np.array(V.FOOTPRINT, float)[:, 2]


def on_screen(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii), rows of two, of the ellipses that regions around points (rows of three) show as."""
    c = V.CAMERA
    seen = points @ VIEW.T
    unit = SIZE.min() * c["worldScale"] * c["zoom"] * c["focalLength"] / (c["focalLength"] + seen[:, 2:])
    centres = SIZE * (0.5, c["verticalCenter"]) + seen[:, :2] * (1, -1) * unit
    return centres, unit * c["regionRadius"] * (c["footprintX"], c["footprintY"])


def brightness(cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shares of 255 of a background grid that covers the viewport, at places of any shape (..., 2): cells weighted by
    tents of one cell's width along either side; beyond the outermost cells' centres these count alone."""
    weights = []
    for axis, cells_across in enumerate(cells.shape[::-1]):
        place = np.clip(at[..., axis] * cells_across / SIZE[axis] - 0.5, 0, cells_across - 1)
        weights.append(np.maximum(0, 1 - np.abs(place[..., None] - np.arange(cells_across))))
    return np.einsum("...r,rc,...c->...", weights[1], cells / 255, weights[0])


def centre_scores(candidates: np.ndarray, used: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
    """total, background and overlap of candidate centres beside used ones; lower totals are better."""
    centres, radii = on_screen(candidates)
    background = np.average(brightness(cells, centres[:, None] + PROBES * radii[:, None]), axis=1, weights=PROBE_WEIGHTS)
    low, high = np.array([V.INSETS["left"], V.INSETS["top"]]), SIZE - [V.INSETS["right"], V.INSETS["bottom"]]
    beyond = np.concatenate([low - (centres - radii), centres + radii - high], axis=1) / np.tile(radii, 2)
    edge = (np.maximum(0, beyond) ** 2).sum(axis=1)
    overlap, apart = np.zeros(len(candidates)), np.zeros(len(candidates))
    if len(used):
        others, reach = on_screen(used)
        gaps = np.linalg.norm((centres[:, None] - others) / (radii[:, None] + reach), axis=2)
        overlap = (np.maximum(0, 1 - gaps) ** 2).sum(axis=1)
        apart = np.linalg.norm((candidates[:, None] - used) / np.array(V.SEPARATION_SCALE), axis=2).min(axis=1)
    return {"total": background + V.EDGE_WEIGHT * edge + V.OVERLAP_WEIGHT * overlap - V.SEPARATION_WEIGHT * apart, "background": background, "overlap": overlap}


def best_centres(regions: DataFrame, cells: list[list[int]], radius: float = 3.0) -> DataFrame:
    """(regionId, center, background, overlap): each region in turn, by hash, takes the candidate of the lowest score.

    cells is the brightness of the background as a grid. The choice is sequential; more than ten regions are an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.arange(CANDIDATES)
        y = 1 - 2 * (k + 0.5) / CANDIDATES
        r, a = np.sqrt(1 - y * y), k * np.pi * (3 - np.sqrt(5))
        points = np.round(np.stack([np.cos(a) * r, y, np.sin(a) * r], axis=1) * radius, 6)
        used, out = np.zeros((0, 3)), []
        for region in pdf.sort_values(["h", "regionId"])["regionId"]:
            s = centre_scores(points, used, np.array(cells, float))
            best = np.lexsort((k, np.round(s["background"], 12), np.round(s["overlap"], 12), np.round(s["total"], 12)))[0]
            used = np.vstack([used, points[best]])
            out.append((region, points[best].tolist(), float(s["background"][best]), float(s["overlap"][best])))
        return pd.DataFrame(out, columns=["regionId", "center", "background", "overlap"])

    kind = dict(regions.dtypes)["regionId"]
    rows = at_most(regions.select("regionId", fnv1a(F.col("regionId").cast("string")).alias("h")), MOST_REGIONS, "regions")
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: run(pdf), f"regionId {kind}, center array<double>, background double, overlap double")


def paper_positions(papers: DataFrame, centres: DataFrame, spread: float = 1.6) -> DataFrame:
    """(paperId, position): a region's papers in hash order on a cloud around its centre."""
    w = Window.partitionBy("regionId").orderBy(fnv1a(F.col("paperId").cast("string")), "paperId")
    rows = papers.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("regionId"))).join(centres, "regionId")
    radius = spread * F.cbrt((F.col("k") + 0.5) / F.col("n"))
    point = sphere_point(F.col("k"), F.col("n"), radius)
    return rows.select("paperId", "regionId", F.transform(F.arrays_zip(point.alias("p"), F.col("center").alias("c")), lambda z: F.round(z["p"] + z["c"], 6)).alias("position"))


def mean_background(centres: DataFrame) -> DataFrame:
    """One row (background): the mean cost of the places that best_centres() chose; null without any."""
    return centres.agg(F.round(F.avg("background"), 6).alias("background"))


def overlaps(centres: DataFrame, least: float) -> DataFrame:
    """(a, b, distance) of centres nearer than `least`; tens of rows."""
    a, b = centres.alias("a"), centres.alias("b")
    d = F.sqrt(sum((F.pow(F.col("a.center")[k] - F.col("b.center")[k], F.lit(2.0)) for k in range(3)), F.lit(0.0)))
    return a.join(b, F.col("a.regionId") < F.col("b.regionId")).select(F.col("a.regionId").alias("a"), F.col("b.regionId").alias("b"), F.round(d, 6).alias("distance")).where(F.col("distance") < least)
