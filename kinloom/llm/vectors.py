"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking by cosine.

A rotation learned on at most SAMPLED vectors turns each vector into a balanced binary code. Every vector
is put into several tables by substrings of its code; vectors of equal label that share a substring are
compared by the cosine of the original vectors in double precision. The substrings' width grows with the
logarithm of the table's rows. Tables are added until at most MISSED of trial pairs at the threshold itself
meet in none: the learning sample's own vectors, each turned to that cosine, and both coded as all vectors
are, after centring. Where MOST_TABLES don't do, the substrings get narrower, at last empty, where all
vectors meet. A pair that several tables find counts in the first.

Equal vectors of a label are one class with a weight. A full table place is cut into blocks of BLOCK
classes, and pairs of blocks are compared: only counts of links and edges of a spanning forest leave a
task, never all pairs.

Vectors that are null, zero or hold null or non-finite components, rows without a label and rows without an
id link with nothing (n_links 0, component the own id, kept). Vectors of different lengths link with
nothing of each other. Rows that repeat link like any two equal vectors. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.shared import Workspace, bounded_batches, components

SAMPLED, ROUNDS, MOST_BITS = 8192, 40, 64
BLOCK, PLACE_ROWS = 512, 512
LEAST_WIDTH, MOST_WIDTH = 8, 24
MISSED, MOST_TABLES, TURNED_AT_ONCE = 1e-3, 256, 1024


@dataclass(frozen=True)
class Codes:
    """Bits: whether the rotated, centred unit vector is positive."""

    mean: np.ndarray
    rotation: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors (n, d) as unsigned 64-bit numbers."""
        on = ((unit - self.mean) @ self.rotation) > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def learned(unit: np.ndarray) -> Codes:
    """Iterative quantisation: principal directions, then the rotation nearest to its own signs, in turns."""
    mean = unit.mean(0)
    x = unit - mean
    bits = min(MOST_BITS, x.shape[1])
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:bits].T
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(7).standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (left @ right).T
    return Codes(mean, axes @ r)


def turned(unit: np.ndarray, cosine: float, draw: np.random.Generator, among: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors at this cosine to the given ones, in random directions, or towards random vectors of `among`."""
    noise = draw.standard_normal(unit.shape)
    aim = noise if among is None else among[draw.integers(len(among), size=len(unit))] + 1e-9 * noise
    aim = aim - (aim * unit).sum(1, keepdims=True) * unit
    size = np.sqrt((aim * aim).sum(1, keepdims=True))
    return np.where(size > 0, cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * aim / np.where(size > 0, size, 1), unit)


def differing(codes: Codes, unit: np.ndarray, cosine: float) -> np.ndarray:
    """(2, n): the bits that differ in trial pairs at this cosine, in random directions and towards other vectors."""
    draw, unit = np.random.default_rng(13), np.unique(unit, axis=0)
    own = unit[draw.permutation(len(unit))[np.arange(SAMPLED) % len(unit)]]
    parts = (own[k : k + TURNED_AT_ONCE] for k in range(0, len(own), TURNED_AT_ONCE))
    return np.concatenate([np.stack([codes.of(u) ^ codes.of(turned(u, cosine, draw, among)) for among in (None, unit)]) for u in parts], 1)


def mask(pick: np.ndarray) -> np.uint64:
    return np.uint64(sum(1 << int(p) for p in pick))


def tables(rows: int, codes: Codes, unit: np.ndarray, cosine: float) -> list[np.ndarray]:
    """The bits of each table's substring; unit: the vectors that the codes were learned on."""
    differ = differing(codes, unit, cosine)
    width = min(codes.bits, max(LEAST_WIDTH, min(MOST_WIDTH, math.ceil(math.log2(max(rows, 1) / PLACE_ROWS)))))
    for wide in range(width, 0, -1):
        draw, out, left = np.random.default_rng(11), [], np.zeros(0, int)
        missed = np.ones(differ.shape, bool)
        while len(out) < MOST_TABLES and missed.mean(1).max() > MISSED:
            if len(left) < wide:
                left = draw.permutation(codes.bits)
            out.append(np.sort(left[:wide]))
            missed &= (differ & mask(out[-1])) != 0
            left = left[wide:]
        if missed.mean(1).max() <= MISSED:
            return out
    return [np.zeros(0, int)]


def places(codes: np.ndarray, picks: list[np.ndarray]) -> np.ndarray:
    """(n, tables): the substring of each code in each table."""
    bit = lambda p: (codes >> np.uint64(p)) & np.uint64(1)
    return np.stack([sum((bit(p) << np.uint64(k) for k, p in enumerate(pick)), np.zeros(len(codes), np.uint64)) for pick in picks], 1).astype(np.int64)


def units(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors scaled to length one, None where they can link with nothing."""
    out = []
    for x in column:
        v = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid and not x.values.null_count else np.zeros(0)
        top = np.abs(v).max(initial=0)
        if not len(v) or not np.isfinite(v).all() or top == 0:
            out.append(None)
            continue
        v = v / top  # neither overflow nor underflow when squared
        out.append(v / math.sqrt(float((v * v).sum())))
    return out


def trained(rows: DataFrame, total: int) -> tuple[Codes, np.ndarray] | None:
    """Codes learned on a sample of about SAMPLED rows (id, label, x), on the most frequent vector length, and the sample."""
    limit = int(min(1.0, SAMPLED / max(total, 1)) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("itq"), "id"), F.lit(1 << 30)) < limit).select("x").limit(4 * SAMPLED)
    own = [u for u in units(sample.toArrow().column(0).combine_chunks()) if u is not None] if total else []
    if not own:
        return None
    size = max({len(u) for u in own}, key=lambda n: sum(len(u) == n for u in own))
    unit = np.stack([u for u in own if len(u) == size])
    return learned(unit), unit


def linked_pairs(unit: np.ndarray, asks: slice, told: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    near = unit[asks] @ unit[told].T >= cosine - 1e-9
    i, j = np.nonzero(near)
    i, j = i + asks.start, j + told.start
    good = (i != j) & ((unit[i] * unit[j]).sum(1) >= cosine)
    return i[good], j[good]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place it is connected with."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def near_vectors(df: DataFrame, *, cosine: float = 0.98, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Links among df's vectors of equal label: (key, n_links, component_id, kept)."""
    spark = df.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "vectors")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{column}`").alias("x"))
    fit = rows.where("id is not null and label is not null and x is not null")
    total = fit.count()
    codes, sample = trained(fit, total) or (None, None)
    picks = tables(total, codes, sample, cosine) if codes else [np.zeros(0, int)]
    masks = [mask(p) for p in picks]

    def code(batches):
        for b in batches:
            own = units(b.column(2))
            of = np.zeros(len(own), np.uint64)
            at = [k for k, u in enumerate(own) if u is not None and codes and len(u) == len(codes.mean)]
            if at:
                of[at] = codes.of(np.stack([own[k] for k in at]))
            raw = [None if u is None else u.tobytes() for u in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(of.view(np.int64))], ["id", "label", "v", "code"])

    known = rows.mapInArrow(code, "id long, label string, v binary, code long")
    live = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    known = ws.store(known.withColumn("h1", F.when(live, F.xxhash64("label", "v"))).withColumn("h2", F.when(live, F.xxhash64("v", F.lit("2"), "label"))))
    least = known.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    least = ws.store(least)
    classes = known.where("h1 is not null").join(least, ["h1", "h2"]).where("id = rep").dropDuplicates(["h1", "h2"]).select("h1", "h2", "rep", "w", "label", "code", "v")
    classes = ws.store(classes)

    def place(batches):
        for b in batches:
            at = places(b.column(5).to_numpy().view(np.uint64), picks)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(at), pa.list_(pa.int64()))], [*b.schema.names, "at"])

    spread = classes.mapInArrow(place, "h1 long, h2 long, rep long, w long, label string, code long, v binary, at array<long>")
    spread = spread.select("h1", "h2", "rep", "w", "label", "code", "v", F.posexplode("at").alias("t", "at")).withColumn("place", F.xxhash64("label", F.octet_length("v"), "t", "at"))
    large = spread.groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("place", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    cut = spread.join(ws.store(large), "place", "left")
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("h1", "h2"), n).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = cut.withColumn("group", F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other"))).withColumn("first", F.col("own") <= F.col("other"))
    dealt = cut.select("group", "first", "own", "other", "t", "h1", "h2", "rep", "w", "label", "code", "v").repartition("group").sortWithinPartitions("group")

    def compare(table: pa.Table):
        c = {f: table.column(f).to_numpy(zero_copy_only=False) for f in ("first", "own", "other", "t", "h1", "h2", "rep", "w", "code")}
        group = table.column("group").to_numpy()
        names, v = np.array(table.column("label").to_pylist(), object), table.column("v").to_pylist()
        starts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        counts, left, right = [], [], []
        for s, e in zip(starts, starts[1:]):
            if e - s < 2:
                continue
            order = s + np.argsort(~c["first"][s:e].astype(bool), kind="stable")
            size = len(v[s])
            if any(len(v[k]) != size for k in order):
                continue  # different places whose 64-bit names are equal
            unit = np.frombuffer(b"".join(v[k] for k in order), float).reshape(e - s, -1)
            whole = bool((c["own"][order] == c["other"][order]).all())
            firsts = int(c["first"][order].astype(bool).sum())
            i, j = linked_pairs(unit, slice(0, e - s if whole else firsts), slice(0 if whole else firsts, e - s), cosine)
            if not len(i):
                continue
            code, t = c["code"][order].view(np.uint64), c["t"][s]
            differ = code[i] ^ code[j]
            new = (names[order[i]] == names[order[j]]) & ((differ & masks[t]) == 0)
            for earlier in masks[:t]:
                new &= (differ & earlier) != 0
            i, j = i[new], j[new]
            if not whole:
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
            weight = np.bincount(i, weights=c["w"][order[j]], minlength=e - s)
            hit = np.flatnonzero(weight)
            counts.append((c["h1"][order[hit]], c["h2"][order[hit]], weight[hit].astype(np.int64)))
            low = forest(e - s, i, j)
            own = np.flatnonzero(low != np.arange(e - s))
            left.append(c["rep"][order[low[own]]])
            right.append(c["rep"][order[own]])
        a = [np.concatenate(x) for x in zip(*counts)] if counts else [np.zeros(0, np.int64)] * 3
        u, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        none = pa.nulls(len(u), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2]), pa.nulls(len(a[0]), pa.int64()), pa.nulls(len(a[0]), pa.int64())], ["h1", "h2", "n", "u", "v"])
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(u), pa.array(w)], ["h1", "h2", "n", "u", "v"])

    def run(batches):
        left = None
        for b in batches:
            now = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])]).combine_chunks()
            if not now.num_rows:
                continue
            group = now.column("group").to_numpy()
            last = int(np.searchsorted(group, group[-1], "left"))
            left = now.slice(last)
            if last:
                yield from compare(now.slice(0, last).combine_chunks())
        if left is not None and left.num_rows:
            yield from compare(left.combine_chunks())

    found = ws.store(dealt.mapInArrow(run, "h1 long, h2 long, n long, u long, v long"))
    part = components(ws, found.where("u is not null").select("u", "v"))
    n_links = found.where("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    per = least.join(n_links, ["h1", "h2"], "left").join(part, F.col("rep") == F.col("id"), "left")
    per = per.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = known.select("id", "h1", "h2").join(per, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
