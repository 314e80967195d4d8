"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length: a bucket is a narrow range of norms, neighbouring small buckets are
joined and large ones cut, so that a block has at most about BLOCK rows. Queries come in blocks too. A
query's k-th best score over the SEEDS longest candidates is a lower bound of its final k-th best. Against
a block whose longest vector has norm m it must meet the cosine bound / (|q| m): blocks that it can't meet
for any query of a block are never paired. Inside a pair of blocks each query takes the cheaper pruning
that its local cosine threshold allows: from COORDINATE upwards the feasible range of its largest
coordinates, below it the length, that is, the block's rows from the longest down. What is left is
verified by its exact integer product.

A vector is the floor of `scale` times each component. Vectors that are null or hold a null or non-finite
component, and rows without an id, take no part. Shorter vectors count as filled up with zeros. A query is
a distinct (id, vector) whose id is divisible by `every`; rows with its id are its own and no candidates,
all other rows count as often as they occur. Sums are exact in double precision up to 2^53; beyond it they
are formed from whole numbers of any size and held at the limits of a long. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.shared import Workspace, bounded_batches

BLOCK, QUERY_BLOCK, SEEDS = 4096, 512, 1024
#: Norm buckets for each doubling of the norm; doubles have at most 2100 doublings.
FINENESS = 70
COORDINATE, FOCUS = 0.8, 3
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(df: DataFrame, key: str, column: str, scale: float) -> DataFrame:
    """(id, v, norm, h): whole-number vectors as doubles in bytes, norms, and a spread for the blocks."""

    def run(batches):
        for b in batches:
            ids, raw, norms = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(float))
                if np.isfinite(v).all():
                    ids.append(i)
                    raw.append(v.tobytes())
                    norms.append(float(np.hypot.reduce(v)) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(norms, pa.float64())], ["id", "v", "norm"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{column}`").alias("x")).mapInArrow(run, "id long, v binary, norm double")
    return rows.withColumn("h", F.xxhash64("id", "v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, vs, high): rows by norm bucket in blocks of about `size` rows, longest norm high."""
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * FINENESS)).otherwise(F.lit(-(1 << 30))).cast("int")
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"))
    # one row for each bucket, of which doubles have a bounded number
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = counts.select("bucket", F.floor(before / size).alias("first"), F.ceil(F.col("c") / size).alias("parts"))
    placed = rows.withColumn("bucket", bucket).join(F.broadcast(plan), "bucket")
    block = F.struct("first", F.when(F.col("parts") > 1, F.col("bucket")).alias("bucket"), F.when(F.col("parts") > 1, F.pmod("h", "parts")).alias("part"))
    return placed.groupBy(block.alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"), F.max("norm").alias("high"))


def matrix(vs: list[bytes], width: int) -> np.ndarray:
    if all(len(v) == 8 * width for v in vs):
        return np.frombuffer(b"".join(vs), float).reshape(len(vs), width)
    out = np.zeros((len(vs), width))
    for row, v in zip(out, vs):
        row[: len(v) // 8] = np.frombuffer(v, float)
    return out


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact whole inner products (queries, rows)."""
    largest = (np.abs(q).max(initial=0) * np.abs(p).max(initial=0)) * max(q.shape[1], 1)
    if largest < 2**53:
        return (q @ p.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m.tolist()] for m in (q, p))
    each = [[min(max(sum(x * y for x, y in zip(r, s)), _LONG[0]), _LONG[1]) for s in b] for r in a]
    return np.array(each, dtype=np.int64).reshape(len(a), len(b))


def feasible(q: np.ndarray, rows: np.ndarray, order: np.ndarray, ordered: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of unit vectors that may reach a cosine with the unit vector q, by its FOCUS largest coordinates."""
    focus = np.argsort(-np.abs(q))[:FOCUS]
    # on the sphere a coordinate's angle may differ from the query's by the threshold's angle
    angle, wide = np.arccos(np.clip(q[focus], -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    low, high = np.cos(np.minimum(np.pi, angle + wide)) - 1e-9, np.cos(np.maximum(0, angle - wide)) + 1e-9
    best = [order[f, np.searchsorted(ordered[f], a, "left") : np.searchsorted(ordered[f], b, "right")] for f, a, b in zip(focus, low, high)]
    k = int(np.argmin([len(x) for x in best]))
    found = best[k]
    for j, f in enumerate(focus):
        if j != k:
            own = rows[found, f]
            found = found[(own >= low[j]) & (own <= high[j])]
    return found


def best_of(qi: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores.astype(object) if (scores == _LONG[0]).any() else -scores, qi))
    ranked = qi[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    return order[place < k]


def met(query: dict, rows: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row id, score) of each query's k best rows of a block that reach its bound."""
    width = max([len(v) // 8 for v in [*query["vs"], *rows["vs"]]], default=0)
    q, p = matrix(query["vs"], width), matrix(rows["vs"], width)
    qids, pids = np.array(query["ids"], np.int64), np.array(rows["ids"], np.int64)
    bounds = np.array([-np.inf if b is None else b for b in query["bounds"]])
    qn, pn = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
    down = np.argsort(-pn, kind="stable")
    p, pids, pn = p[down], pids[down], pn[down]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((qn > 0) & (bounds > 0), bounds / (qn * max(pn[0], 1e-300)), -1.0) - 1e-9
        length = np.where((qn > 0) & (bounds > 0), bounds / qn, 0.0) * (1 - 1e-9)
    reach = np.searchsorted(-pn, -length, "right")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sharp = np.flatnonzero((local >= COORDINATE) & (local <= 1) & (reach > 0))
    if len(sharp):
        unit = p / np.maximum(pn, 1e-300)[:, None]
        order = np.argsort(unit.T, axis=1)
        ordered = np.take_along_axis(unit.T, order, 1)
        for i in sharp:
            own = feasible(q[i] / qn[i], unit, order, ordered, float(local[i]))
            found.append((np.full(len(own), i), own, products(q[i : i + 1], p[own])[0]))
    plain = np.flatnonzero((local < COORDINATE) & (reach > 0))
    plain = plain[np.argsort(-reach[plain], kind="stable")]
    for at in range(0, len(plain), 128):
        own = plain[at : at + 128]
        s = products(q[own], p[: reach[own[0]]])
        a, b = np.nonzero(s >= bounds[own][:, None])
        found.append((own[a], b, s[a, b]))
    qi, pi, s = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    qi, pi, s = qi.astype(np.int64), pi.astype(np.int64), s.astype(np.int64)
    good = (s >= bounds[qi]) & (qids[qi] != pids[pi])
    qi, pi, s = qi[good], pi[good], s[good]
    keep = best_of(qi, pids[pi], s, k)
    return qi[keep], pids[pi[keep]], s[keep]


def top_products(df: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k best candidates of each query of df: query_id, rank (from 1), vec_id, score."""
    spark = df.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "topk")
    rows = ws.store(whole_vectors(df, key, column, scale))
    seed = rows.orderBy(F.desc("norm"), "id", "h").limit(SEEDS).select("id", "v").collect()
    seeds = {"ids": [r.id for r in seed], "vs": [bytes(r.v) for r in seed]}

    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "norm", "h").distinct()
    grouped = blocks(asked, QUERY_BLOCK).select("ids", "vs")

    def bounded(batches):
        for b in batches:
            for ids, vs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                q = {"ids": ids, "vs": vs, "bounds": [None] * len(ids)}
                at, _, s = met(q, seeds, k) if seeds["ids"] else (np.zeros(0, int), None, np.zeros(0, int))
                count = np.bincount(at, minlength=len(ids))
                least = np.full(len(ids), _LONG[1])
                np.minimum.at(least, at, s)
                bounds = [int(x) if c >= k else None for c, x in zip(count, least)]
                norms = [float(np.hypot.reduce(np.frombuffer(v, float))) if v else 0.0 for v in vs]
                reach = min([0.0 if x is None or x <= 0 or n == 0 else x / n for x, n in zip(bounds, norms)], default=0.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids], pa.list_(pa.int64())), pa.array([vs], pa.list_(pa.binary())), pa.array([bounds], pa.list_(pa.int64())), pa.array([reach * (1 - 1e-9)])], ["ids", "vs", "bounds", "reach"]
                )

    queries = ws.store(grouped.mapInArrow(bounded, "ids array<long>, vs array<binary>, bounds array<long>, reach double").withColumn("n", F.monotonically_increasing_id()))
    found = ws.store(blocks(rows, BLOCK).withColumnRenamed("ids", "pids").withColumnRenamed("vs", "pvs"))
    # each block of rows meets the query blocks that it can reach: equality joins on a slot of the query block
    slots = max(1, queries.count())
    queries = queries.withColumn("slot", F.pmod(F.xxhash64("n"), F.lit(slots)).cast("int"))
    pairs = found.select("block", "high", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).join(queries.select("n", "slot", "reach"), "slot").where("high >= reach")
    both = found.join(pairs.select("block", "n"), "block").join(queries.drop("reach", "slot"), "n").select("ids", "vs", "bounds", "pids", "pvs")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, vs, bounds, pids, pvs = (c[i].as_py() for c in b.columns)
                qi, vec, s = met({"ids": ids, "vs": vs, "bounds": bounds}, {"ids": pids, "vs": pvs}, k)
                own = np.array(ids, np.int64)[qi]
                tags = np.array([hash_of(v) for v in vs], np.int64)[qi]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(tags), pa.array(vec), pa.array(s)], ["query_id", "tag", "vec_id", "score"])

    hits = both.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def hash_of(v: bytes) -> int:
    """A number for a query's vector, so that different vectors of one id keep apart."""
    return xxhash.xxh64_intdigest(v) - (1 << 63)
