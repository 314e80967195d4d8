"""Sketches: each item's set of hashes, made inside its task without a shuffle.

Columns: id, hashes (sorted, distinct), n. Items without shingles have an empty sketch, which is in no
pair and stays a cluster of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import kmers, shingled
from kinloom.functions.durable import python_ready


def shingle_sets(df: DataFrame, id: str, text: str, width: int, most: int | None = None) -> DataFrame:
    """Full sets of word-shingle hashes, or of each set the `most` smallest."""
    python_ready(df.sparkSession)
    own = df.select(F.col(id).cast("long").alias("id"), F.lower(F.col(text)).alias("text"))
    return _sized(own.mapInArrow(shingled.sets(width, most), "id long, hashes array<long>"))


def kmer_sets(df: DataFrame, id: str, sequence: Column, k: int) -> DataFrame:
    """Full sets of canonical k-mer hashes of a sequence."""
    hashes = F.coalesce(kmers.distinct_hashes(kmers.canonical_kmers(sequence, k)), F.array().cast("array<long>"))
    return _sized(df.select(F.col(id).cast("long").alias("id"), hashes.alias("hashes")))


def dimension_sets(df: DataFrame, id: str, sequence: Column, k: int, level: int) -> DataFrame:
    """Sets of canonical k-mers sampled by dimension, a share of 16^-level of all."""
    hashes = F.coalesce(kmers.dimension_hashes(kmers.canonical_kmers(sequence, k), k, level), F.array().cast("array<long>"))
    return _sized(df.select(F.col(id).cast("long").alias("id"), hashes.alias("hashes")))


def cardinalities(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n): about how many distinct hashes each group of groups(id, group) has, by merged HyperLogLog sketches."""
    each = sets.select("id", F.explode("hashes").alias("h")).groupBy("id").agg(F.hll_sketch_agg("h", 12).alias("s"))
    return each.join(groups, "id").groupBy("group").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n"))


def grouped(sets: DataFrame) -> DataFrame:
    """One set for each id of many records (an item of several parts)."""
    each = sets.select("id", F.explode_outer("hashes").alias("h")).distinct()
    return _sized(each.groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("hashes")))


def from_pairs(df: DataFrame, id: str, item: str) -> DataFrame:
    """Sets of whole numbers, given as rows (id, item)."""
    return _sized(df.select(F.col(id).cast("long").alias("id"), F.col(item).cast("long").alias("h")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("hashes")))


def bottom(sets: DataFrame, size: int) -> DataFrame:
    """The `size` smallest hashes of each set."""
    return _sized(sets.withColumn("hashes", kmers.bottom(F.col("hashes"), size)))


def containment_sized(sets: DataFrame, lengths: DataFrame, compress: int, least: int = 100) -> DataFrame:
    """Sketches that grow with the item: length / compress hashes, `least` at the fewest. lengths: id, length."""
    size = F.greatest(F.lit(least), F.floor(F.coalesce("length", F.lit(0)) / compress).cast("int"))
    return _sized(sets.join(lengths, "id", "left").select("id", kmers.bottom(F.col("hashes"), size).alias("hashes")))


def mod_sampled(sets: DataFrame, rate: int) -> DataFrame:
    """Hashes divisible by `rate`."""
    return _sized(sets.withColumn("hashes", kmers.sampled(F.col("hashes"), rate)))


def long_enough(df: DataFrame, length: str, least: int) -> DataFrame:
    return df.where(F.col(length) >= least)


def size_probe(df: DataFrame, length: str, least: int) -> DataFrame:
    """(n, max_size, min_size, avg_size, total_size, bad) of an item table; bad: shorter than `least`."""
    n = F.col(length)
    return df.agg(F.count(n).alias("n"), F.max(n).alias("max_size"), F.min(n).alias("min_size"), F.round(F.avg(n), 6).alias("avg_size"), F.sum(n).alias("total_size"), F.count_if(n < least).alias("bad"))


def tuned(probe: DataFrame, k: int, size: int, threshold: float, compress: int | None = None) -> DataFrame:
    """Parameters that fit a size_probe(): the k to use, the sketch's reach, whether the threshold is within it.

    k is replaced by the recommended one if it is below the least safe length or over 3 above the recommended.
    """
    log4 = lambda p: F.ceil(F.log(F.col("max_size") * (1 - p) / p) / F.log(F.lit(4.0)) - 1e-9)
    out = probe.withColumn("k_recommended", log4(1e-4)).withColumn("k_least", log4(1e-2))
    use = F.when((F.lit(k) < F.col("k_least")) | (F.lit(k) > F.col("k_recommended") + 3), F.col("k_recommended")).otherwise(F.lit(k))
    out = out.withColumn("k", use).withColumn("sketch_size", F.greatest(F.lit(1), F.floor(F.col("avg_size") / compress)) if compress else F.lit(size))
    j = 1 / F.col("sketch_size")
    reach = F.round(-F.log(2 * j / (1 + j)) / F.col("k"), 6)
    return out.select("n", "k_recommended", "k_least", "k", F.col("sketch_size").cast("long").alias("sketch_size"), reach.alias("max_distance"), (reach >= threshold).alias("threshold_ok"))


def _sized(df: DataFrame) -> DataFrame:
    return df.select("id", "hashes", F.size("hashes").cast("long").alias("n"))
