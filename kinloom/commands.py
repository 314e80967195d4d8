"""From sequence files to clusters, databases and answers: what a session or the command line calls.

cluster() reads FASTA files, sketches, clusters and writes a cluster file beside a folder of state; append(),
recluster(), build(), query() and assign() go on from such a folder. Every option works with every method, and
threshold="auto" cuts where the forest's gaps say.

    python -m kinloom cluster --method mst --input genomes/*.fna --by-file --out clusters
    python -m kinloom recut --state clusters.state --threshold 0.02 --out finer
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import formulas, kmers
from kinloom.functions.durable import Workspace
from kinloom.operators import community, dbscan, graph, greedy, near, pairs, sketch, thresholds, trees
from kinloom.sources import clusterfile, fasta, tables
from kinloom.streaming import repdb

METHODS = ("mst", "greedy", "dbscan", "louvain", "leiden")


def items(spark: SparkSession, paths, *, listed: bool = False, by_file: bool = True, least: int = 10_000) -> DataFrame:
    """(id, name, comment, sequences, length): one item for each file or record of the paths, or of the list they name."""
    if not by_file and not listed:
        wrong = [p for p in ([paths] if isinstance(paths, str) else paths) if not fasta.suffix_ok(p)]
        if wrong:
            raise ValueError(f"items by record need files that end in one of {fasta.SUFFIXES}: {wrong[0]}")
    records = fasta.read_list(spark, paths) if listed else fasta.read_fasta(spark, paths)
    return fasta.numbered(records, by_file=by_file, least=least)


def sketched(own: DataFrame, *, k: int = 21, size: int = 1000, kind: str = "bottom", compress: int = 1000, level: int = 3) -> DataFrame:
    """Sketches (id, hashes, n) of items: the smallest hashes (bottom), as many as the length asks (containment), or by dimension."""
    every = F.flatten(F.transform("sequences", lambda s: kmers.canonical_kmers(s, k)))
    hashes = kmers.dimension_hashes(every, k, level) if kind == "dimension" else kmers.distinct_hashes(every)
    sets = own.select("id", hashes.alias("hashes"), "length").withColumn("n", F.size("hashes").cast("long"))
    if kind == "bottom":
        return sketch.bottom(sets.select("id", "hashes", "n"), size)
    if kind == "containment":
        return sketch.containment_sized(sets.select("id", "hashes"), own.select("id", "length"), compress)
    return sets.select("id", "hashes", "n")


def clustered(ws: Workspace, sketches: DataFrame, params: dict, state: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(id, cluster) of sketches by params, and the tables worth keeping."""
    k, metric, method, t = params["k"], params["metric"], params["method"], params["threshold"]
    keep = dict(state or {})
    if method == "mst" or t == "auto":
        if "forest" not in keep:
            keep["forest"] = ws.store(graph.spanning_forest(ws, pairs.edges(pairs.pair_counts(sketches), k, metric=metric)))
        if t == "auto":
            t = params["threshold"] = thresholds.best(thresholds.candidates(keep["forest"]), thresholds.edge_stats(keep["forest"]).first())["threshold"]
    if method == "mst":
        return graph.clusters(ws, sketches, graph.cut(keep["forest"], t)).select("id", "cluster"), keep
    counts = near.all_counts(ws, sketches, formulas.min_jaccard(t, k)) if metric == "mash" else pairs.pair_counts(sketches)
    if method in ("louvain", "leiden"):
        counts = counts.where("least(n_i, n_j) * 2 >= greatest(n_i, n_j)")
    edges = ws.store(pairs.edges(counts, k, metric=metric, threshold=t))
    if method == "greedy":
        return greedy.greedy_clusters(ws, sketches, edges).select("id", "cluster"), keep
    if method == "dbscan":
        found = dbscan.dbscan(ws, sketches, edges, min_points=params["min_points"], knn=params["knn"])
        return found.select("id", F.coalesce("cluster", "id").alias("cluster"), "is_noise"), keep
    edges = edges.where(F.col("dist") < t)
    find = community.leiden if method == "leiden" else community.louvain
    return find(ws, sketches, edges, **({} if params["resolution"] is None else {"resolution": params["resolution"]})).select("id", F.col("community").alias("cluster")), keep


def write(ws: Workspace, own: DataFrame, found: DataFrame, params: dict, out: str, keep: dict[str, DataFrame]) -> None:
    """The cluster file at out, the state beside it, trees on demand."""
    members = ws.store(found.join(own.select("id", "length", F.col("name").alias("file"), "name", "comment"), "id"))
    if params["method"] == "dbscan":
        clusterfile.density_lines(members, params["threshold"], params["min_points"]).orderBy("cluster").select("text").write.text(out)
    else:
        clusterfile.write_clusters(members, out, threshold=params["threshold"])
    if params.get("newick") and "forest" in keep:
        trees.newick(ws, keep["forest"]).select("tree").write.text(f"{out}.newick")
    if params.get("report") and "forest" in keep:
        ws.spark.createDataFrame([(x,) for x in thresholds.report(keep["forest"])], "text string").coalesce(1).write.text(f"{out}.thresholds")
    tables.save(f"{out}.state", params, items=own.select("id", "name", "comment", "length"), clusters=found.select("id", "cluster"), **keep)


def cluster(spark: SparkSession, paths, out: str, *, method: str = "mst", threshold: float | str = 0.05, listed: bool = False, by_file: bool = True, least: int = 10_000, k: int = 21, size: int = 1000, kind: str = "bottom", metric: str = "mash", min_points: int = 3, knn: int | None = None, resolution: float | None = None, **more) -> DataFrame:
    """Cluster files' items and write the result; returns (id, cluster)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    ws = Workspace(spark, "commands")
    params = {"method": method, "threshold": threshold, "k": k, "size": size, "kind": kind, "metric": metric, "min_points": min_points, "knn": knn, "resolution": resolution, **more}
    own = ws.store(items(spark, paths, listed=listed, by_file=by_file, least=least))
    sketches = ws.store(sketched(own, k=k, size=size, kind=kind))
    found, keep = clustered(ws, sketches, params)
    found = ws.store(found)
    write(ws, own, found, params, out, keep | {"sketches": sketches})
    return found


def state(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """Parameters and tables of a folder that cluster() or append() wrote."""
    params, found = tables.load(spark, folder, "items", "clusters", "sketches")
    try:
        found |= tables.load(spark, folder, "forest")[1]
    except Exception as e:  # a state without a forest has no such table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return params, found


def append(spark: SparkSession, folder: str, paths, out: str, **reading) -> DataFrame:
    """Add files' items to a saved state and cluster anew: a forest is grown by the new items' edges alone."""
    ws = Workspace(spark, "commands")
    params, old = state(spark, folder)
    own = items(spark, paths, **reading).join(old["items"].select("id"), "id", "left_anti")
    own = ws.store(own)
    new = ws.store(sketched(own, k=params["k"], size=params["size"], kind=params["kind"]))
    every = ws.store(old["sketches"].unionByName(new))
    keep = {}
    if "forest" in old:
        marked = new.select(F.col("id").alias("m"))
        counts = pairs.pair_counts(every)
        grown = counts.join(marked, F.col("i") == F.col("m"), "left_semi").union(counts.join(marked, F.col("j") == F.col("m"), "left_semi")).distinct()
        keep["forest"] = ws.store(graph.appended_forest(ws, old["forest"], pairs.edges(grown, params["k"], metric=params["metric"])))
    found, keep = clustered(ws, every, params, keep)
    found = ws.store(found)
    names = old["items"].unionByName(own.select("id", "name", "comment", "length"))
    write(ws, names, found, params, out, keep | {"sketches": every})
    return found


def recluster(spark: SparkSession, folder: str, out: str, **changed) -> DataFrame:
    """Cluster a saved state by other parameters, from its sketches and its forest: nothing is sketched again."""
    ws = Workspace(spark, "commands")
    params, old = state(spark, folder)
    params |= changed
    kept = {"forest": old["forest"]} if "forest" in old else {}
    found, keep = clustered(ws, old["sketches"], params, kept)
    found = ws.store(found)
    write(ws, old["items"], found, params, out, keep | {"sketches": old["sketches"]})
    return found


def build(spark: SparkSession, folder: str, path: str) -> int:
    """A database of representatives from a saved state: tree medoids of forest clusters, else the clusters' own items."""
    ws = Workspace(spark, "commands")
    params, old = state(spark, folder)
    reps = None
    if params["method"] == "mst":
        close = ws.store(graph.cut(old["forest"], params["threshold"]))
        reps = trees.medoids(ws, close, old["items"].select("id", "length")).select(F.col("component").alias("cluster"), "rep")
    kind = "mst" if params["method"] == "mst" else "greedy"
    return repdb.build(old["sketches"], old["clusters"], k=params["k"], threshold=params["threshold"], metric=params["metric"], kind=kind, reps=reps).save(path)


def asked(spark: SparkSession, folder: str, paths, **reading) -> DataFrame:
    """Sketches of files by a saved state's parameters."""
    params, _ = state(spark, folder)
    return sketched(items(spark, paths, **reading), k=params["k"], size=params["size"], kind=params["kind"])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("kinloom")
    act = parser.add_subparsers(dest="command", required=True)
    reading = argparse.ArgumentParser(add_help=False)
    reading.add_argument("--input", nargs="+", required=True)
    reading.add_argument("--list", dest="listed", action="store_true")
    reading.add_argument("--by-file", action="store_true")
    reading.add_argument("--min-len", dest="least", type=int, default=10_000)
    cutting = argparse.ArgumentParser(add_help=False)
    cutting.add_argument("--threshold", type=lambda x: x if x == "auto" else float(x), default=0.05)
    cutting.add_argument("--method", choices=METHODS, default="mst")
    cutting.add_argument("--min-points", type=int, default=3)
    cutting.add_argument("--knn", type=int)
    cutting.add_argument("--resolution", type=float)
    cutting.add_argument("--newick", action="store_true")
    cutting.add_argument("--report", action="store_true")
    one = act.add_parser("cluster", parents=[reading, cutting])
    one.add_argument("--k", type=int, default=21)
    one.add_argument("--size", type=int, default=1000)
    one.add_argument("--kind", choices=("bottom", "containment", "dimension"), default="bottom")
    one.add_argument("--metric", choices=tuple(formulas.METRICS), default="mash")
    for name, parents in (("append", [reading]), ("recut", [cutting]), ("build", []), ("query", [reading]), ("assign", [reading]), ("stats", [])):
        sub = act.add_parser(name, parents=parents)
        if name != "stats":
            sub.add_argument("--state", required=True)
        if name in ("build", "query", "assign", "stats"):
            sub.add_argument("--db", required=True)
        if name == "query":
            sub.add_argument("--topk", type=int, default=5)
    for name, sub in act.choices.items():
        if name != "build":
            sub.add_argument("--out", required=True)
    o = vars(parser.parse_args(args))
    spark, command = SparkSession.builder.getOrCreate(), o.pop("command")
    paths = o.pop("input", None)
    if paths and o.get("listed"):
        paths = paths[0]
    read = {c: o[c] for c in ("listed", "by_file", "least") if c in o}
    if command == "cluster":
        cluster(spark, paths, o.pop("out"), **o)
    elif command == "append":
        append(spark, o["state"], paths, o["out"], **read)
    elif command == "recut":
        folder, out = o.pop("state"), o.pop("out")
        recluster(spark, folder, out, **o)
    elif command == "build":
        build(spark, o["state"], o["db"])
    elif command == "stats":
        repdb.load(spark, o["db"]).stats().write.json(o["out"])
    else:
        db, queries = repdb.load(spark, o["db"]), asked(spark, o["state"], paths, **read)
        lines = clusterfile.hit_lines(db.query(queries, o["topk"])) if command == "query" else clusterfile.assignment_lines(db.assign(queries))
        lines.orderBy("query").select("text").write.text(o["out"])
