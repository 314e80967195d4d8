"""The shared steps of the queries over the driver's tables, each stored once for a session and a folder."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import formulas
from kinloom.functions.durable import Workspace
from kinloom.operators import graph, greedy, grid, near, pairs, sketch
from kinloom.streaming import repdb

#: Words of a shingle, hashes of a sketch, the clusters' distance, the distance at which noise is looked for.
K, SIZE, NEAR, WIDE = 5, 200, 0.1, 0.5

_STORED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work(spark: SparkSession) -> Workspace:
    return Workspace(spark, "plans")


def contents(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells whether a folder's tables are still the same: their files' names, sizes and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def forget(spark: SparkSession) -> None:
    """Drop all stored steps of a session."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        work(spark).drop(_STORED.pop(key))


def stored(step):
    """Store a step's table once for each session and state of a folder, as an index that later queries read."""

    @wraps(step)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, step.__name__, contents(spark, sf_dir))
        if key not in _STORED:
            _STORED[key] = work(spark).store(step(spark, sf_dir))
        return _STORED[key]

    return once


@stored
def full_sets(spark, sf_dir):
    return sketch.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text", K)


@stored
def sketches(spark, sf_dir):
    return sketch.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text", K, SIZE)


@stored
def lists(spark, sf_dir):
    """(id, n, hashes): documents' hashes that others have too."""
    return pairs.shared_lists(sketches(spark, sf_dir))


def counts(spark, sf_dir):
    """Counts of all pairs, which are as many as the square of the documents: made anew, never stored."""
    return grid.over(lists(spark, sf_dir), grid.Pairs)


def distances(spark, sf_dir):
    return pairs.edges(counts(spark, sf_dir), K)


@stored
def classes(spark, sf_dir):
    """(id, rep, n): documents of equal sketches."""
    return near.classes(sketches(spark, sf_dir))


def _counts_within(spark, sf_dir, distance):
    own = sketches(spark, sf_dir)
    return near.counts(work(spark), near.representing(own, classes(spark, sf_dir)), formulas.min_jaccard(distance, K))


@stored
def class_counts(spark, sf_dir):
    """Counts of the pairs of classes that are near."""
    return _counts_within(spark, sf_dir, NEAR)


def class_edges(spark, sf_dir):
    return pairs.edges(class_counts(spark, sf_dir), K, threshold=NEAR)


def near_counts(spark, sf_dir):
    """Counts of the pairs of documents that are near."""
    return near.expanded(classes(spark, sf_dir), class_counts(spark, sf_dir))


@stored
def near_edges(spark, sf_dir):
    return pairs.edges(near_counts(spark, sf_dir), K, threshold=NEAR)


@stored
def near_forest(spark, sf_dir):
    """The spanning forest up to the clusters' distance, from near pairs alone."""
    return graph.spanning_forest(work(spark), class_edges(spark, sf_dir)).unionByName(near.class_edges(classes(spark, sf_dir)))


@stored
def stable_forest(spark, sf_dir):
    """The spanning forest up to half as much again as the clusters' distance, beyond which its stability doesn't look."""
    edges = pairs.edges(_counts_within(spark, sf_dir, 1.5 * NEAR), K, threshold=1.5 * NEAR)
    return graph.spanning_forest(work(spark), work(spark).store(edges)).unionByName(near.class_edges(classes(spark, sf_dir)))


@stored
def forest(spark, sf_dir):
    """The spanning forest of all candidate pairs, whatever their distance."""
    return graph.spanning_forest(work(spark), pairs.forest_candidates(lists(spark, sf_dir), K))


@stored
def clusters(spark, sf_dir):
    return graph.clusters(work(spark), sketches(spark, sf_dir), graph.cut(near_forest(spark, sf_dir), NEAR))


@stored
def greedy_clusters(spark, sf_dir):
    return greedy.class_clusters(work(spark), sketches(spark, sf_dir), classes(spark, sf_dir), class_edges(spark, sf_dir))


@stored
def baskets(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return sketch.from_pairs(lines.join(orders, lines.l_orderkey == orders.o_orderkey), "o_custkey", "l_partkey")


@stored
def base_clusters(spark, sf_dir):
    base = sketches(spark, sf_dir).where("id % 5 <> 0")
    classed, edges = near.of_some(classes(spark, sf_dir), class_edges(spark, sf_dir), "id % 5 <> 0")
    return greedy.class_clusters(work(spark), base, work(spark).store(classed), work(spark).store(edges))


def database(spark: SparkSession, sf_dir: str, kind: str = "greedy", *, base: bool = False) -> repdb.RepDB:
    """Representatives of all documents; base: of those whose id isn't divisible by 5, for an append of the others."""
    if base:
        return repdb.build(sketches(spark, sf_dir).where("id % 5 <> 0"), base_clusters(spark, sf_dir), k=K, threshold=NEAR, kind=kind)
    return repdb.build(sketches(spark, sf_dir), greedy_clusters(spark, sf_dir), k=K, threshold=NEAR, kind=kind)


@stored
def benchmark_sketches(spark, sf_dir):
    return sketch.shingle_sets(table(spark, sf_dir, "benchmark"), "item_id", "text", K, SIZE)


def truth(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
