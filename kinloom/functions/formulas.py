"""Similarity and distance formulas as Column expressions, also as SQL functions.

c: common hashes; a, b: sizes of the two sketches; k: length of a k-mer or shingle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# fixed values: upper ends of the levels' distances
LEVELS = ((0.001, "identical"), (0.005, "strain/subspecies"), (0.01, "strain"), (0.03, "species"), (0.1, "genus"), (0.2, "family"))
# fixed values: the coarser levels of threshold candidates
FOUR_LEVELS = ((0.01, "strain"), (0.03, "species"), (0.1, "genus"))


def jaccard(c: Column, a: Column, b: Column) -> Column:
    union = a + b - c
    return F.when(union > 0, c / union).otherwise(F.lit(0.0))


def containment(c: Column, a: Column, b: Column) -> Column:
    """Common share of the smaller set."""
    least = F.least(a, b)
    return F.when(least > 0, c / least).otherwise(F.lit(0.0))


def mash_of(j: Column, k: int, clamp: bool = True) -> Column:
    """Distance of a similarity j: -ln(2j / (1 + j)) / k; clamp holds it at 1."""
    d = -F.log(2 * j / (1 + j)) / k
    return F.when(j >= 1, 0.0).when(j <= 0, 1.0).otherwise(F.least(F.lit(1.0), d) if clamp else d)


def mash_distance(c: Column, a: Column, b: Column, k: int, clamp: bool = True) -> Column:
    return mash_of(jaccard(c, a, b), k, clamp)


def aaf_distance(c: Column, a: Column, b: Column, k: int, clamp: bool = True) -> Column:
    """Distance of a containment: -ln(C) / k."""
    share = containment(c, a, b)
    d = -F.log(share) / k
    return F.when(share >= 1, 0.0).when(share <= 0, 1.0).otherwise(F.least(F.lit(1.0), d) if clamp else d)


def mash_containment(c: Column, a: Column, b: Column, k: int, clamp: bool = True) -> Column:
    """The Mash transform of a containment."""
    return mash_of(containment(c, a, b), k, clamp)


METRICS = {"mash": mash_distance, "aaf": aaf_distance, "mash_containment": mash_containment}


def max_size_ratio(t: float, k: int) -> float:
    """No pair whose sizes differ by a larger factor has a Mash distance of t or less."""
    return 2 * math.exp(t * k) - 1


def min_jaccard(t: float, k: int) -> float:
    x = math.exp(-t * k)
    return x / (2 - x)


def min_common(a: Column, b: Column, t: float, k: int) -> Column:
    """Fewest common hashes that a pair of Mash distance t or less can have."""
    j = min_jaccard(t, k)
    return F.ceil(F.lit(j / (1 + j)) * (a + b) - 1e-9)


def reaches(c: Column, a: Column, b: Column, jaccard: float) -> Column:
    """Whether a pair's Jaccard similarity reaches a bound, without a division."""
    return c * (1 + jaccard) >= jaccard * (a + b)


def ani_bucket(d: Column) -> Column:
    """Whole percents of identity, 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor((1 - d) * 100 + 1e-9))).cast("int")


def density_bucket(d: Column) -> Column:
    """The first t with 0.01 t >= d."""
    return F.ceil(d * 100 - 1e-9).cast("int")


def level(d: Column, levels=None) -> Column:
    levels = LEVELS if levels is None else levels
    out = F.when(d < levels[0][0], levels[0][1])
    for end, name in levels[1:]:
        out = out.when(d < end, name)
    return out.otherwise("higher")


def kmer_bounds(largest: float, error: float = 1e-4) -> int:
    """Length at which a random k-mer is in a sequence of that length with a probability of `error`."""
    return math.ceil(math.log(largest * (1 - error) / error) / math.log(4))


def sketch_reach(k: int, size: int, least_common: int = 1) -> float:
    """The largest distance that a sketch of that size can show."""
    j = least_common / size
    return -math.log(2 * j / (1 + j)) / k


def register(spark: SparkSession) -> None:
    """The formulas as temporary SQL functions, plain expressions that the optimizer inlines."""
    for name, args, body in (
        ("jaccard", "c DOUBLE, a DOUBLE, b DOUBLE", "CASE WHEN a + b - c > 0 THEN c / (a + b - c) ELSE 0 END"),
        ("containment", "c DOUBLE, a DOUBLE, b DOUBLE", "CASE WHEN least(a, b) > 0 THEN c / least(a, b) ELSE 0 END"),
        ("mash_of", "j DOUBLE, k INT", "CASE WHEN j >= 1 THEN 0D WHEN j <= 0 THEN 1D ELSE least(1D, -ln(2 * j / (1 + j)) / k) END"),
        ("aaf_of", "c DOUBLE, k INT", "CASE WHEN c >= 1 THEN 0D WHEN c <= 0 THEN 1D ELSE least(1D, -ln(c) / k) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
