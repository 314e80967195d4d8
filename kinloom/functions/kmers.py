"""Shingles, k-mers and their hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the bases and what each pairs with
BASES, PAIRED = "ACGT", "TGCA"


def hash60(x: Column) -> Column:
    """60 bits of the md5: never negative, so that order by sign and by size agree."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long")


def windows(n: Column, width: int) -> Column:
    """1 .. n - width + 1; empty where n < width."""
    return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's inner loop would compute an expression at every step."""
    return F.transform(F.array(value), body)[0]


def word_shingles(text: Column, width: int) -> Column:
    """Lower-cased shingles of `width` words."""
    return bound(F.split(F.trim(text), r"\s+"), lambda words: F.transform(windows(F.size(words), width), lambda i: F.lower(F.array_join(F.slice(words, i, width), " "))))


def distinct_hashes(items: Column) -> Column:
    """Sorted distinct hashes; a set is a row's array, so no row moves."""
    return F.array_sort(F.array_distinct(F.transform(items, hash60)))


def bases(text: Column) -> Column:
    """Letters as bases for texts that aren't sequences: a-g A, h-m C, n-s G, t-z T, all else N."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", "_"), "abcdefghijklmnopqrstuvwxyz_", "A" * 7 + "C" * 6 + "G" * 6 + "T" * 7 + "N")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; A < C < G < T also by letters."""
    return F.least(kmer, F.reverse(F.translate(kmer, BASES, PAIRED)))


def canonical_kmers(sequence: Column, k: int, block: int = 256) -> Column:
    """Canonical k-mers of a sequence; a window with a letter other than A, C, G, T has none.

    Only runs of these letters that hold a window are cut. Blocks that overlap by k - 1 letters keep each window's
    place near the start of a short string.
    """

    def blocks(s: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.length(s) - k + 1, F.lit(block))
        return F.transform(cuts, lambda i: F.substring(s, i, F.lit(block + k - 1)))

    runs = F.filter(F.split(F.upper(sequence), f"[^{BASES}]+"), lambda s: F.length(s) >= k)
    parts = F.flatten(F.transform(runs, blocks))
    return F.transform(F.flatten(F.transform(parts, lambda x: F.transform(windows(F.length(x), k), lambda j: F.substring(x, j, F.lit(k))))), canonical)


def mixed_dimension(x, bits: int, xor=lambda a, b: a.bitwiseXOR(b), right=lambda a, n: F.shiftright(a, n), low=lambda a, m: a.bitwiseAND(F.lit(m))):
    """A fixed bijection of numbers of `bits` bits, at most 24: the order in which dimensions are taken."""
    mask = (1 << bits) - 1
    x = low(x * (0x9E3779B1 & mask | 1), mask)
    x = xor(x, right(x, bits // 2))
    return low(x * (0x85EBCA77 & mask | 1), mask)


def dimension_hashes(kmers: Column, k: int, level: int) -> Column:
    """Hashes of the canonical k-mers (k even, at most 28) whose middle falls into one of 16^-level of all dimensions.

    The middle bases are the dimension; a kept k-mer's hash is its outer bases and the place of its dimension.
    """
    half, sub, outer = dimension_plan(k, level)

    def one(x: Column) -> Column:
        u = F.conv(F.translate(x, BASES, "0123"), 4, 10).cast("long")
        place = mixed_dimension(F.shiftright(u, 2 * outer).bitwiseAND(F.lit((1 << 4 * sub) - 1)), 4 * sub)
        rest = F.shiftright(u, 2 * outer + 4 * sub) * (1 << 2 * outer) + u.bitwiseAND(F.lit((1 << 2 * outer) - 1))
        return F.struct(place.alias("place"), (rest * (1 << 4 * (sub - level)) + place).alias("hash"))

    kept = F.filter(F.transform(kmers, one), lambda s: s["place"] < (1 << 4 * (sub - level)))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda s: s["hash"])))


def dimension_plan(k: int, level: int) -> tuple[int, int, int]:
    """Half of k, half the bases of a dimension, half the bases outside."""
    half, sub = k // 2, 6 if level <= 4 else level + 2
    if k % 2 or k > 28 or sub > min(half, 6):
        raise ValueError("k must be even, from 12 to 28, and the level at most 4")
    return half, sub, half - sub


def sampled(hashes: Column, rate: int) -> Column:
    """The hashes divisible by `rate`: a share of the set that grows with it."""
    return F.filter(hashes, lambda h: h % rate == 0)


def bottom(hashes: Column, size: Column | int) -> Column:
    """The `size` smallest of sorted distinct hashes."""
    return F.slice(hashes, 1, size)
