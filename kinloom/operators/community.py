"""Louvain and Leiden communities, component by component with the whole graph's weight.

Moves across components never raise the quality, so each component is one group of by_group(); the
order of nodes is fixed, so results repeat. Weights are 1 - distance.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace, python_ready
from kinloom.operators.graph import by_tree
from kinloom.operators.order import by_group

PASSES = 100


def _local_moves(graph: dict, size: dict, total: float, resolution: float, cpm: bool, start: dict | None = None) -> dict:
    """Each node's community after moving single nodes to their best neighbouring one until none gains, from single nodes or from start."""
    community = {v: v for v in graph} if start is None else dict(start)
    degree = {v: sum(graph[v].values()) for v in graph}
    mass = {v: (size[v] if cpm else degree[v]) for v in graph}
    inside: dict = defaultdict(float)
    for v in graph:
        inside[community[v]] += mass[v]
    for _ in range(PASSES):
        moved = False
        for v in sorted(graph):
            own, weights = community[v], defaultdict(float)
            for u, w in graph[v].items():
                if u != v:
                    weights[community[u]] += w
            inside[own] -= mass[v]
            cost = lambda c: resolution * mass[v] * inside[c] / (1 if cpm else total)
            best, gain = own, weights[own] - cost(own)
            for c in sorted(weights):
                if weights[c] - cost(c) > gain + 1e-12:
                    best, gain = c, weights[c] - cost(c)
            inside[best] += mass[v]
            community[v], moved = best, moved or best != own
        if not moved:
            break
    return community


def _pieces(graph: dict, community: dict) -> dict:
    """Communities cut into their connected pieces, each named by its smallest node."""
    out: dict = {}
    for v in sorted(graph):
        if v not in out:
            stack, out[v] = [v], v
            while stack:
                for u in graph[stack.pop()]:
                    if u not in out and community[u] == community[v]:
                        out[u] = v
                        stack.append(u)
    return out


def _refined(graph: dict, size: dict, resolution: float, community: dict) -> dict:
    """Each community taken apart and merged anew: a single node that is well tied to its community joins the part of it,
    itself well tied to the rest, that gains most. Parts are connected."""
    all_in: dict = defaultdict(float)
    for v in graph:
        all_in[community[v]] += size[v]
    part, members = {v: v for v in graph}, {v: 1 for v in graph}
    mass = {v: size[v] for v in graph}
    out = {v: sum(w for u, w in graph[v].items() if u != v and community[u] == community[v]) for v in graph}
    for v in sorted(graph):
        rest = all_in[community[v]] - size[v]
        if part[v] != v or members[v] > 1 or out[v] < resolution * size[v] * rest:
            continue
        ties: dict = defaultdict(float)
        for u, w in graph[v].items():
            if u != v and community[u] == community[v]:
                ties[part[u]] += w
        best, gain = None, 0.0
        for c in sorted(ties):
            tied = out[c] >= resolution * mass[c] * (all_in[community[v]] - mass[c])
            if tied and ties[c] - resolution * size[v] * mass[c] > gain + 1e-12:
                best, gain = c, ties[c] - resolution * size[v] * mass[c]
        if best is not None:
            out[best] += out[v] - 2 * ties[best]
            mass[best] += size[v]
            members[best] += 1
            part[v] = best
    return part


def communities(edges: list[tuple[int, int, float]], total: float, resolution: float, cpm: bool, refine: bool) -> dict:
    """Each node's community, named by its smallest node; refine: levels are built from refined parts, communities are connected."""
    whole: dict = defaultdict(dict)
    for i, j, w in edges:
        whole[i][j] = whole[j][i] = w
    graph, start = dict(whole), None
    size, label = {v: 1 for v in graph}, {v: v for v in graph}
    while True:
        found = _local_moves(graph, size, total, resolution, cpm, start)
        done = len(set(found.values())) == len(graph)
        parts = found if done or not refine else _refined(graph, size, resolution, found)
        if not done and len(set(parts.values())) == len(graph):
            parts = _pieces(graph, found)
        if done or len(set(parts.values())) == len(graph):
            break
        above: dict = defaultdict(lambda: defaultdict(float))
        sizes: dict = defaultdict(int)
        for v, row in graph.items():
            sizes[parts[v]] += size[v]
            for u, w in row.items():
                above[parts[v]][parts[u]] += w
        label = {v: parts[c] for v, c in label.items()}
        start = {parts[v]: found[v] for v in graph} if refine else None
        graph, size = {v: dict(above[v]) for v in sizes}, sizes
    label = {v: found[c] for v, c in label.items()}
    label = _pieces(whole, label) if refine else label
    least: dict = {}
    for v, c in label.items():
        least[c] = min(v, least.get(c, v))
    return {v: least[c] for v, c in label.items()}


def louvain(ws: Workspace, nodes: DataFrame, edges: DataFrame, *, resolution: float = 1.0) -> DataFrame:
    """(id, community) by modularity; community: its smallest id."""
    return _found(ws, nodes, edges, resolution, False, False)


def leiden(ws: Workspace, nodes: DataFrame, edges: DataFrame, *, resolution: float = 0.5) -> DataFrame:
    """(id, community) by the constant Potts model with unit nodes, local moves and refinement; communities are connected.

    Weights are spread over 0 to 1 where they range over less than a half.
    """
    return _found(ws, nodes, edges, resolution, True, True)


def sweep(ws: Workspace, nodes: DataFrame, edges: DataFrame, resolutions: list[float], *, find=leiden) -> DataFrame:
    """(resolution, communities, largest, single): the same stored edges at several resolutions."""
    out = None
    for r in resolutions:
        sizes = ws.store(find(ws, nodes, edges, resolution=r)).groupBy("community").agg(F.count("*").alias("c"))
        row = sizes.agg(F.lit(float(r)).alias("resolution"), F.count("*").alias("communities"), F.max("c").alias("largest"), F.count_if(F.col("c") == 1).alias("single"))
        out = row if out is None else out.union(row)
    return out


def _found(ws: Workspace, nodes: DataFrame, edges: DataFrame, resolution: float, cpm: bool, refine: bool) -> DataFrame:
    python_ready(ws.spark)
    edges = ws.store(edges.select("i", "j", "dist"))
    seen = edges.agg(F.sum(1 - F.col("dist")).alias("w"), F.min(1 - F.col("dist")).alias("low"), F.max(1 - F.col("dist")).alias("high")).first()
    total, low, wide = 2 * (seen.w or 1.0), seen.low or 0.0, (seen.high or 0.0) - (seen.low or 0.0)
    spread = refine and 1e-6 < wide < 0.5

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["j", "i"])
        weight = 1 - rows["dist"]
        weight = (weight - low) / wide if spread else weight
        got = communities([*zip(rows["i"].tolist(), rows["j"].tolist(), weight.tolist())], total, resolution, cpm, refine)
        return pd.DataFrame({"id": [*got], "community": [*got.values()]})

    part = by_group(by_tree(ws, edges), "component", run, "id long, community long")
    return nodes.select("id").join(part, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
