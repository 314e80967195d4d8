"""Cluster files, as text and as tables, and the other text outputs.

A file has an optional head of # lines, then for each cluster a line "the cluster N is: ", a line with
tabs for each member (place, id, length, file, name, comment) and an empty line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace
from kinloom.operators.order import numbered


def cluster_lines(members: DataFrame, *, threshold: float | None = None) -> DataFrame:
    """(cluster, text): each cluster as a block of text, from members(cluster, id, length, file, name, comment).

    Clusters are numbered by their smallest id. With a threshold a head with cluster -1 is added.
    """
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id")) - 1
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    line = F.format_string("\t%d\t%d\t%dnt\t%s\t%s\t%s", place, "id", F.coalesce("length", F.lit(0)), fill("file"), fill("name"), fill("comment"))
    rows = members.select("cluster", "id", place.alias("place"), line.alias("line"))
    blocks = rows.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]).alias("lines"))
    numbers, _ = numbered(Workspace(members.sparkSession, "clusterfile"), blocks, "cluster", name="number")
    number = F.col("number")
    out = numbers.select(number.cast("long").alias("cluster"), F.concat(F.lit("the cluster "), number.cast("string"), F.lit(" is: \n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text"))
    if threshold is None:
        return out
    head = blocks.agg(F.lit(-1).cast("long").alias("cluster"), F.format_string("# Clustering threshold: %.6f\n# Total clusters: %d\n#", F.lit(float(threshold)), F.count("*")).alias("text"))
    return head.union(out)


def write_clusters(members: DataFrame, path: str, *, threshold: float | None = None) -> None:
    """Write a cluster file's parts in order; the table of members stays the primary product."""
    cluster_lines(members, threshold=threshold).orderBy("cluster").select("text").write.text(path)


def density_lines(members: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(cluster, text) of density clusters, from members(cluster, id, length, file, name, comment, is_noise): a head with cluster -1,
    the clusters by their smallest core, then each noise item as a cluster of its own."""
    far = F.lit(1 << 62)
    placed = members.withColumn("cluster", F.when(F.col("is_noise"), F.col("id") + far).otherwise(F.col("cluster")))
    head = members.agg(F.lit(-1).cast("long").alias("cluster"), F.format_string("# DBSCAN clustering parameters: eps=%.6f, minPts=%d\n# Total clusters: %d\n# Total noise points (outliers): %d\n#", F.lit(float(eps)), F.lit(min_points), F.count_distinct("cluster"), F.count_if("is_noise")).alias("text"))
    return head.union(cluster_lines(placed))


def by_size(clustered: DataFrame) -> DataFrame:
    """(cluster, size, number): clusters numbered from 0, larger ones first, then by their names."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("size"))
    return numbered(Workspace(clustered.sparkSession, "clusterfile"), sizes, F.desc("size"), F.col("cluster"), name="number")[0].select("cluster", "size", "number")


def accessions(spark: SparkSession, path: str, pattern: str = r"GC[AF]_\d+\.\d+") -> DataFrame:
    """(cluster, accession): the names in a cluster file's lines that fit a pattern."""
    blocks = spark.read.text(path, lineSep="the cluster ").select(F.regexp_extract("value", r"^(\d+) is:", 1).alias("cluster"), F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("found")).where("cluster <> ''")
    return blocks.select(F.col("cluster").cast("long").alias("cluster"), F.explode("found").alias("accession"))


def assignment_lines(assigned: DataFrame) -> DataFrame:
    """Assignments as tab-separated lines; a novel query has cluster -1."""
    own = F.format_string("%s\t%d\t%s\t%.6f\t%d\tassigned", F.col("query").cast("string"), "cluster", F.col("rep").cast("string"), "distance", "cluster_size")
    none = F.concat(F.col("query").cast("string"), F.lit("\t-1\tunassigned\t-1\t0\tnovel"))
    return assigned.select("query", F.when(F.col("status") == "novel", none).otherwise(own).alias("text"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, place, id, length, file, name, comment) of a cluster file; head lines and blanks are skipped."""
    blocks = spark.read.text(path, lineSep="the cluster ").select(F.regexp_extract("value", r"^(\d+) is:", 1).alias("cluster"), F.split("value", "\n").alias("lines")).where("cluster <> ''")
    rows = blocks.select(F.col("cluster").cast("long").alias("cluster"), F.explode("lines").alias("line")).where(F.startswith("line", F.lit("\t")))
    p = F.split("line", "\t")
    return rows.select("cluster", F.get(p, F.lit(1)).cast("int").alias("place"), F.get(p, F.lit(2)).cast("long").alias("id"), F.regexp_extract(F.get(p, F.lit(3)), r"^\d+", 0).cast("long").alias("length"), F.get(p, F.lit(4)).alias("file"), F.get(p, F.lit(5)).alias("name"), F.get(p, F.lit(6)).alias("comment"))


def looks_like_clusters(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is no head is a cluster's."""
    first = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").limit(1).collect()
    return bool(first) and first[0].value.startswith("the cluster ")


def distinct_files(clusters: DataFrame) -> DataFrame:
    return clusters.select("file").where("file is not null and file <> 'N/A'").distinct()


def linkage_lines(linkage: DataFrame) -> DataFrame:
    """Merges as lines "c1 c2 dist size"."""
    return linkage.select("component", "step", F.format_string("%d\t%d\t%.6f\t%d", "c1", "c2", "dist", "size").alias("text"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """Query hits as tab-separated lines; a query without a hit has rank 0 and no_match."""
    own = F.format_string("%s\t%d\t%s\t%.6f\t%d\t%d", F.col("query").cast("string"), "rank", F.col("rep").cast("string"), "distance", "cluster", "cluster_size")
    none = F.concat(F.col("query").cast("string"), F.lit("\t0\tno_match\t-1\t-1\t0"))
    return hits.select("query", "rank", F.when(F.col("rank") == 0, none).otherwise(own).alias("text"))
