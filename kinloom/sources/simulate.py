"""Sequences with known clusters, for tests: mutated copies of seeds, prefixes of seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions.kmers import BASES


def _bases(seed: int, *keys: str):
    """A base by a hash of the seed and the keys: the same at every run and for every partitioning."""
    return F.substring(F.lit(BASES), F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(4)).cast("int") + 1, F.lit(1))


def mutated(spark: SparkSession, seeds: int, copies: int, length: int, rate: float, *, seed: int = 1) -> DataFrame:
    """(id, label, name, sequence): each seed and its copies; a base is changed, left out or doubled with `rate`."""
    rows = spark.range(seeds * copies).select("id", F.floor(F.col("id") / copies).alias("label"), (F.col("id") % copies).alias("copy"))
    at = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("p"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("mutate"), "id", "p"), F.lit(1 << 30)) / (1 << 30)
    own, new = _bases(seed, "label", "p"), _bases(seed + 1, "id", "p")
    kind = F.pmod(F.xxhash64(F.lit(seed), F.lit("kind"), "id", "p"), F.lit(3))
    changed = F.when((F.col("copy") == 0) | (chance >= rate), own).when(kind == 0, new).when(kind == 1, F.concat(own, new)).otherwise("")
    whole = at.select("id", "label", "copy", "p", changed.alias("b")).groupBy("id", "label", "copy").agg(F.array_sort(F.collect_list(F.struct("p", "b"))).alias("s"))
    name = F.concat(F.lit("seq_"), F.col("label").cast("string"), F.when(F.col("copy") > 0, F.concat(F.lit("_mutation_"), F.col("copy").cast("string"))).otherwise(""))
    return whole.select("id", F.col("label").cast("long").alias("label"), name.alias("name"), F.array_join(F.transform("s", lambda x: x["b"]), "").alias("sequence"))


def contained(items: DataFrame, copies: int, *, seed: int = 1) -> DataFrame:
    """(id, label, sequence): prefixes of items(id, sequence) of hashed proportions."""
    rows = items.select(F.col("id").alias("label"), "sequence", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    share = F.pmod(F.xxhash64(F.lit(seed), "label", "copy"), F.lit(1000)) / 1000
    size = F.when(F.col("copy") == 0, F.length("sequence")).otherwise(F.greatest(F.lit(1), (F.length("sequence") * share).cast("int")))
    return rows.select((F.col("label") * copies + F.col("copy")).alias("id"), "label", F.substring("sequence", F.lit(1), size).alias("sequence"))
