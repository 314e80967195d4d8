"""After clustering: noise by density, duplicates, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace
from kinloom.operators import graph, trees


def noise(clustered: DataFrame, density: DataFrame) -> DataFrame:
    """(id) of noise: in clusters (id, cluster, size) of two or more, those of a density (id, cnt) at or below
    max(min(q - 1, 2), 0), q being the cluster's density at a quarter of its sorted members."""
    dens = clustered.where("size >= 2").join(density, "id", "left").select("id", "cluster", "size", F.coalesce("cnt", F.lit(0)).alias("d"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("d", "id")) - 1
    ranked = dens.withColumn("r", rank)
    limit = ranked.where(F.col("r") == F.floor(F.col("size") / 4)).select("cluster", F.greatest(F.least(F.col("d") - 1, F.lit(2)), F.lit(0)).alias("limit"))
    return ranked.join(limit, "cluster").where("d <= limit").select("id")


def without_noise(ws: Workspace, nodes: DataFrame, forest: DataFrame, noisy: DataFrame) -> DataFrame:
    """(id, cluster, size) after edges at noise are gone; noise becomes single."""
    return graph.clusters(ws, nodes, graph.without_noise(forest, noisy))


def dedup_groups(ws: Workspace, nodes: DataFrame, forest: DataFrame, lengths: DataFrame, dedup_distance: float) -> DataFrame:
    """(id, dup_group, rep): groups of forest edges up to a distance and their tree medoids; at 0 or less all stay."""
    if dedup_distance <= 0:
        return nodes.select("id", F.col("id").alias("dup_group"), F.col("id").alias("rep"))
    close = ws.store(graph.cut(forest, dedup_distance))
    grouped = graph.clusters(ws, nodes, close)
    reps = trees.medoids(ws, close, lengths).select(F.col("component").alias("cluster"), "rep")
    return grouped.join(reps, "cluster", "left").select("id", F.col("cluster").alias("dup_group"), F.coalesce("rep", "cluster").alias("rep"))


def first_members(clustered: DataFrame) -> DataFrame:
    """(cluster, rep): each cluster's first member."""
    return clustered.groupBy("cluster").agg(F.min("id").alias("rep"))
