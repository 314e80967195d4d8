"""Choosing a cut: edge statistics, gaps, candidates, the best one, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import formulas
from kinloom.functions.durable import Workspace
from kinloom.operators.order import numbered

TINY = 1e-10


def ranked(forest: DataFrame) -> DataFrame:
    """(dist, r, n): distances above zero with their places in the order of all."""
    own = forest.where(F.col("dist") > TINY).select(F.round("dist", 9).alias("dist"))
    places, n = numbered(Workspace(forest.sparkSession, "ranks"), own, "dist")
    return places.join(F.broadcast(n))


def edge_stats(forest: DataFrame) -> DataFrame:
    """One row: n, min, q1, median, q3, max, mean and population deviation, quantiles by place."""
    at = lambda p, name: F.max(F.when(F.col("r") == p, F.col("dist"))).alias(name)
    own, n = ranked(forest), F.col("n")
    middle = (at(F.floor(n / 2), "m1"), at(F.floor((n - 1) / 2), "m0"))
    out = own.agg(F.count("*").alias("n"), F.min("dist").alias("min_dist"), at(F.floor(n / 4), "q1"), *middle, at(F.least(n - 1, F.floor(3 * n / 4)), "q3"), F.max("dist").alias("max_dist"), F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("min_dist", "q1")), F.round((F.col("m0") + F.col("m1")) / 2, 6).alias("median"), *(F.round(c, 6).alias(c) for c in ("q3", "max_dist", "mean", "std")))


def gaps(forest: DataFrame, ratio: float = 0.05, most: int = 5) -> DataFrame:
    """(edge_index, threshold, gap): the widest steps between neighbouring distances above `ratio` of the range."""
    own = ranked(forest)
    wide = own.agg((F.max("dist") - F.min("dist")).alias("range"))
    before = own.select((F.col("r") + 1).alias("r"), F.col("dist").alias("before"))
    found = own.join(before, "r").select("r", "dist", (F.col("dist") - F.col("before")).alias("gap")).join(F.broadcast(wide)).where(F.col("gap") > F.col("range") * ratio)
    best = found.orderBy(F.desc("gap"), "r").limit(most)
    return best.select(F.col("r").cast("long").alias("edge_index"), F.round("dist", 6).alias("threshold"), F.round("gap", 6).alias("gap"), F.round(F.least(F.lit(1.0), 10 * F.col("gap") / F.col("range")), 6).alias("confidence"))


def candidates(forest: DataFrame, ratio: float = 0.05) -> list[dict]:
    """Candidate thresholds by gaps and quartiles, ascending: threshold, gap_score, confidence, level, cluster_edges.

    The driver sees the statistics' single row, at most five gaps and a count for each candidate.
    """
    stats = edge_stats(forest).first()
    if stats is None or stats.n < 2:
        return []
    wide = stats.max_dist - stats.min_dist
    if wide <= TINY:
        found = [(stats.median, 0.0, 0.5)]
    else:
        found = [(g.threshold, g.gap, g.confidence) for g in gaps(forest, ratio).collect()]
        for q, least in ((stats.q1, 0.001), (stats.median, 0.0), (stats.q3, 0.0)):
            close = any(abs(q - t) < wide * ratio * 0.5 for t, _, _ in found)
            if q >= max(least, 0.001) and not close and stats.min_dist < q < stats.max_dist:
                found.append((q, 0.0, 0.4))
    return [{"threshold": t, "gap_score": g, "confidence": c, "level": level_name(t)} for t, g, c in sorted(found)]


def report(forest: DataFrame, ratio: float = 0.05) -> list[str]:
    """The lines of a threshold analysis: statistics, the chosen threshold, all candidates. Distances stay a table."""
    stats, found = edge_stats(forest).first(), candidates(forest, ratio)
    chosen = best(found, stats)
    keep = stability(forest, chosen["threshold"])
    number = lambda x: f"{x or 0:.6f}"
    lines = ["# Automatic Threshold Selection Analysis", "# Based on MST Edge Length Distribution", "# ===========================================", "", "## Edge Length Statistics", f"Total edges: {stats.n}"]
    lines += [f"{name}: {number(stats[c])}" for name, c in (("Min distance", "min_dist"), ("Max distance", "max_dist"), ("Mean distance", "mean"), ("Median distance", "median"), ("Q1 (25%)", "q1"), ("Q3 (75%)", "q3"), ("Standard deviation", "std"))]
    lines += [f"Range: {number((stats.max_dist or 0) - (stats.min_dist or 0))}", "", "## Optimal Threshold (Recommended)", f"Threshold: {number(chosen['threshold'])}", f"Confidence: {chosen['confidence']:.3f}", f"Stability (overall): {keep['stability']:.3f}", f"Suggested level: {chosen['level']}", "", "## All Candidate Thresholds", "# Threshold\tConfidence\tLevel\tGap_Score"]
    return lines + [f"{number(c['threshold'])}\t{c['confidence']:.3f}\t{c['level']}\t{number(c['gap_score'])}" for c in found]


def level_name(d: float) -> str:
    return next((name for end, name in formulas.LEVELS if d < end), "higher")


def best(found: list[dict], stats=None) -> dict:
    """The candidate of the highest score; the first wins ties; without any, the median in .01 to .2 or 0.05."""
    score, chosen = 0.0, None
    for c in found:
        t = c["threshold"]
        if t < 0.001:
            continue
        weight = 2.0 if 0.01 <= t <= 0.1 else 1.2 if 0.001 <= t < 0.01 else 1.1 if 0.1 < t <= 0.2 else 1.0
        if (s := c["confidence"] * weight + 20 * c["gap_score"]) > score:
            score, chosen = s, c
    if chosen is None:
        middle = stats.median if stats is not None and stats.n and 0.01 <= stats.median <= 0.2 else 0.05
        return {"threshold": middle, "confidence": 0.0, "gap_score": 0.0, "level": level_name(middle) if middle != 0.05 else "unknown"}
    return chosen


def stability(forest: DataFrame, threshold: float) -> dict:
    """How few forest edges change sides near a threshold: overall, split and merge consistency.

    The width around it grows from 0.01, or from half the threshold where that is less, until 100 edges are near.
    """
    near, width, low, high = 0, min(0.01, threshold / 2), threshold, threshold
    while near < 100 and 0 < width <= threshold / 2:
        low, high = max(0.0, threshold - width), threshold + width
        near = forest.where(F.col("dist").between(low, high)).count()
        width *= 1.5
    if not near:
        return {"stability": 1.0, "split": 1.0, "merge": 1.0, "near_edges": 0}
    at = [low + (high - low) * i / 4 for i in range(5)]
    flips = forest.agg(*(F.count_if((F.col("dist") > min(t, threshold)) & (F.col("dist") <= max(t, threshold))).alias(f"f{i}") for i, t in enumerate(at))).first()
    keep = [1 - flips[i] / near for i in range(5)]
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.5
    split, merge = mean([k for k, t in zip(keep, at) if t < threshold]), mean([k for k, t in zip(keep, at) if t > threshold])
    return {"stability": min(split, merge), "split": split, "merge": merge, "near_edges": near}
