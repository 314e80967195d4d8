"""Components, minimum spanning forests and what follows from them, for graphs of any size.

Edges are (i, j, dist). Every loop cuts its lineage by a stored table.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace, python_ready

if TYPE_CHECKING:  # workers of other stages import this module and have no use for pandas
    import pandas as pd


#: Edges of a forest that one task may join; more go through rounds of joins, of which none holds a component.
ONE_TASK = 1 << 18
#: Edges that a task holds besides its forest.
EDGES_HELD = 1 << 20


def least_ids(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of edges (u[k], v[k]), sorted, and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(ids)), at.reshape(2, -1)
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        np.minimum.at(root, b, a)
        while (root != (up := root[root])).any():
            root = up
    return ids, ids[root]


def _joined(everything: bool):
    """From edges (u, v) of a task to the edges (id, smallest id reached) of their forest, and if everything, of the smallest ids too."""

    def run(batches):
        held, many, size = [], 0, 0
        for b in batches:
            held.append([b.column(0).to_numpy(), b.column(1).to_numpy()])
            many += b.num_rows
            if many > 2 * size + EDGES_HELD:
                held = [list(least_ids(*map(np.concatenate, zip(*held))))]
                many = size = len(held[0][0])
        if held:
            ids, root = least_ids(*map(np.concatenate, zip(*held)))
            if not everything:
                ids, root = ids[ids != root], root[ids != root]
            for k in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(root[k : k + 100_000])], ["u", "v"])

    return run


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) of all ids of edges (u, v), component being the smallest id reachable.

    Each part of the edges first becomes a forest of its own. Up to ONE_TASK edges of forests are then joined by one
    task, without a shuffle. More alternate large-star and small-star: a hub's neighbours are aggregated in parts and joined, so that
    no task holds a component; the rounds grow with the logarithm of the largest one. ws.drop() frees the result.
    """
    rows = edges.where("u <> v").select("u", "v")
    if {t for _, t in rows.dtypes} == {"bigint"}:
        python_ready(ws.spark)
        forests = ws.store(rows.mapInArrow(_joined(False), "u long, v long"))
        if forests.count() <= ONE_TASK:
            found = ws.store(forests.coalesce(1).mapInArrow(_joined(True), "u long, v long").select(F.col("u").alias("id"), F.col("v").alias("component")))
            ws.drop(forests)
            return found
        rows = forests
    now, mark = _marked(ws, rows.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct())
    ws.drop(rows)
    while True:
        after, seen = _marked(ws, _small_star(_large_star(now)))
        ws.drop(now)
        if seen == mark:
            break
        now, mark = after, seen
    roots = after.select(F.col("v").alias("id")).distinct()
    found = after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
    found.stored_at = after.stored_at
    return found


def _marked(ws: Workspace, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges stored, and what tells whether they have changed."""
    seen = Observation()
    own = edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64("v", "u") % 1000003), F.lit(0)).alias("s"))
    table = ws.store(own)
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    out = both.join(low, both.u == low.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    moved = edges.join(low, edges.u == low.c).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def clusters(ws: Workspace, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster, size) of all nodes(id); a node without an edge is a cluster of its own."""
    part = components(ws, edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
    own = nodes.select("id").join(part, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"))
    return own.join(sizes, "cluster").select("id", "cluster", "size")


def _kruskal(rows: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows, keep = rows.sort_values(["dist", "j", "i"]), []
    for i, j in zip(rows["i"].tolist(), rows["j"].tolist()):
        a, b = root(i), root(j)
        keep.append(a != b)
        if a != b:
            parent[a] = b
    return rows[keep]


def spanning_forest(ws: Workspace, edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges (i, j, dist); the order (dist, j, i) makes it the only one.

    Parts of the edges first shed what is the last edge of a circle in them; Boruvka's rounds then add the
    least edge that leaves each component, by aggregation alone.
    """
    python_ready(ws.spark)

    def shed(batches):
        import pandas as pd

        kept, size = None, 0
        for b in batches:
            kept = b if kept is None else pd.concat([kept, b])
            if len(kept) > 2 * size + 100_000:
                kept = _kruskal(kept)
                size = len(kept)
        if kept is not None:
            yield _kruskal(kept)

    own = edges.select("i", "j", "dist").repartition("j").mapInPandas(shed, "i long, j long, dist double")
    rest, forest, place = ws.store(own), None, None
    while not rest.isEmpty():
        ends = rest if place is None else rest
        at = ends.withColumns({"a": F.col("i"), "b": F.col("j")}) if place is None else ends
        least = F.min(F.struct("dist", "j", "i", "a", "b")).alias("e")
        best = at.groupBy(F.col("a").alias("c")).agg(least).union(at.groupBy(F.col("b").alias("c")).agg(least)).groupBy("c").agg(F.min("e").alias("e"))
        chosen = ws.store(best.select("e.*").distinct())
        forest = chosen.select("i", "j", "dist") if forest is None else forest.union(chosen.select("i", "j", "dist"))
        part = ws.store(components(ws, chosen.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        to = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"{c}_to"))
        moved = at.join(to("a"), "a", "left").join(to("b"), "b", "left")
        moved = moved.select("i", "j", "dist", F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b")).where("a <> b")
        place, rest = True, ws.store(moved)
    return forest if forest is not None else edges.select("i", "j", "dist").limit(0)


def appended_forest(ws: Workspace, forest: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest of a grown table: the old forest and the edges that have a new end; the old other edges aren't needed."""
    return spanning_forest(ws, forest.select("i", "j", "dist").unionByName(edges.select("i", "j", "dist")))


def cut(forest: DataFrame, threshold: float) -> DataFrame:
    return forest.where(F.col("dist") <= threshold)


def by_tree(ws: Workspace, forest: DataFrame) -> DataFrame:
    """forest with the component of each edge."""
    part = components(ws, forest.select(F.col("i").alias("u"), F.col("j").alias("v")))
    return forest.join(part, forest.i == part.id).select("component", "i", "j", "dist")


def without_noise(edges: DataFrame, noise: DataFrame) -> DataFrame:
    """Edges that touch no id of noise(id)."""
    return edges.join(noise.select(F.col("id").alias("i")), "i", "left_anti").join(noise.select(F.col("id").alias("j")), "j", "left_anti").select("i", "j", "dist")
