"""Ground truth, taxonomy, reports and saved graphs as tables; sets of tables in a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(key, label, organism) of a file with a head line and columns parted by white space; the first row of a key counts."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+", 3).alias("p")).where("line > 0 and size(p) >= 2")
    return raw.groupBy(F.col("p")[0].alias("key")).agg(F.min_by("p", "line").alias("p")).select("key", F.col("p")[1].alias("label"), F.get("p", F.lit(2)).alias("organism"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent, rank) of a nodes dump."""
    p = F.split("value", r"\t?\|\t?")
    return spark.read.text(path).select(p[0].cast("long").alias("id"), p[1].cast("long").alias("parent"), p[2].alias("rank"))


def ani_report(spark: SparkSession, path: str) -> DataFrame:
    """The seven columns of an identity report; missing numbers are 0."""
    names = ("accession", "species_taxid", "best_match_species_taxid", "best_match_status", "excluded_from_refseq", "qcoverage", "scoverage")
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="na").toDF(*names)
    number = lambda c, t: F.coalesce(F.try_to_number(c, F.lit("999999999999.999999")).cast(t), F.lit(0).cast(t)).alias(c)
    return raw.select("accession", number("species_taxid", "long"), number("best_match_species_taxid", "long"), "best_match_status", "excluded_from_refseq", number("qcoverage", "double"), number("scoverage", "double"))


def saved_graph(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, dist) of a text graph "from to weight" under a line of counts; weights are 1 - dist."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") == 3)
    ends = rows.select(F.col("p")[0].cast("long").alias("a"), F.col("p")[1].cast("long").alias("b"), (1 - F.col("p")[2].cast("double")).alias("dist"))
    return ends.select(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j"), "dist")


def save_graph(edges: DataFrame, path: str) -> None:
    edges.select(F.format_string("%d %d %.6f", "j", "i", 1 - F.col("dist")).alias("value")).write.text(path)


def save(path: str, params: dict, **tables: DataFrame) -> None:
    """Write parameters and tables into a new folder."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.parquet(f"{path}/params")


def load(spark: SparkSession, path: str, *names: str) -> tuple[dict, dict[str, DataFrame]]:
    params = json.loads(spark.read.parquet(f"{path}/params").first().params)
    return params, {n: spark.read.parquet(f"{path}/{n}") for n in names}
