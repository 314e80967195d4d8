"""A database of representatives: build, query, assign, append, statistics; append as a stream's sink.

A database is a folder of versions, each a set of tables: params, reps(rep, cluster, hashes, n) and
members(id, cluster). An append writes a new version and then its marker; readers take the newest marked
version, so a lost executor or a failed append leaves the old one whole.

kind "greedy": an appended item joins its nearest representative or opens a cluster, in the order of
sketch size. kind "mst": items that match several clusters merge them, the nearest representative stays.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import formulas
from kinloom.functions.durable import Workspace
from kinloom.operators import greedy, pairs
from kinloom.operators.graph import components
from kinloom.operators.order import numbered
from kinloom.sources import tables


#: Folders of one version, at most; then all is written into one.
FOLDERS = 32


@dataclass
class RepDB:
    """Representatives and members in memory as tables; params: k, threshold, metric, kind."""

    params: dict
    reps: DataFrame
    members: DataFrame
    #: Where it was loaded from, and (reps, members) that a greedy append has added since.
    stored: tuple[str, tuple[str, ...]] | None = None
    added: tuple[DataFrame, DataFrame] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.reps.sparkSession

    def sizes(self) -> DataFrame:
        return self.members.groupBy("cluster").agg(F.count("*").alias("cluster_size"))

    def hits(self, queries: DataFrame) -> DataFrame:
        """(q, r, distance) of queries (id, hashes, n) that share a hash with a representative."""
        own = self.reps.select(F.col("rep").alias("id"), "hashes", "n")
        met = pairs.cross_counts(queries, own)
        return met.select("q", "r", formulas.METRICS[self.params["metric"]](F.col("common"), F.col("n_q"), F.col("n_r"), self.params["k"]).alias("distance"))

    def query(self, queries: DataFrame, k: int = 5, *, prefilter: bool = False) -> DataFrame:
        """(query, rank, rep, distance, cluster, cluster_size): the k nearest; rank 0 and nulls without a match."""
        found = self.hits(queries)
        if prefilter:
            found = found.where(F.col("distance") <= self.params["threshold"])
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "r"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).join(self.reps.select(F.col("rep").alias("r"), "cluster"), "r").join(self.sizes(), "cluster", "left")
        out = queries.select(F.col("id").alias("query")).join(best, F.col("query") == F.col("q"), "left")
        return out.select("query", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("r").alias("rep"), F.round("distance", 6).alias("distance"), "cluster", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size"))

    def assign(self, queries: DataFrame) -> DataFrame:
        """(query, cluster, rep, distance, cluster_size, status): assigned within the threshold, else novel."""
        best = self.query(queries, 1)
        near = (F.col("rank") > 0) & (F.col("distance") <= self.params["threshold"])
        keep = lambda c: F.when(near, F.col(c)).alias(c)
        return best.select("query", keep("cluster"), keep("rep"), keep("distance"), F.when(near, F.col("cluster_size")).otherwise(0).alias("cluster_size"), F.when(near, "assigned").otherwise("novel").alias("status"))

    def stats(self) -> DataFrame:
        """One row of totals, cluster sizes with quantiles by place, and sketch sizes."""
        places, n = numbered(Workspace(self.spark, "repdb"), self.sizes(), "cluster_size", "cluster")
        sizes = places.join(F.broadcast(n))
        at = lambda q, name: F.max(F.when(F.col("r") == F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("cluster_size"))).alias(name)
        own = sizes.agg(F.count("*").alias("clusters"), F.sum("cluster_size").alias("members"), F.min("cluster_size").alias("min_size"), F.max("cluster_size").alias("max_size"), F.round(F.avg("cluster_size"), 6).alias("mean_size"), at(0.5, "median_size"), at(0.9, "p90_size"), at(0.95, "p95_size"), at(0.99, "p99_size"), F.count_if(F.col("cluster_size") == 1).alias("singletons"))
        sketch = self.reps.agg(F.min("n").alias("min_sketch"), F.max("n").alias("max_sketch"), F.round(F.avg("n"), 6).alias("mean_sketch"))
        post = pairs.posting_counts(self.reps.select(F.col("rep").alias("id"), "hashes", "n")).agg(F.count("*").alias("hashes"), F.max("c").alias("max_posting"), F.round(F.avg("c"), 6).alias("avg_posting"))
        return own.join(F.broadcast(sketch)).join(F.broadcast(post))

    def size_histogram(self) -> DataFrame:
        """(size_class, clusters)."""
        s = F.col("cluster_size")
        kind = F.when(s == 1, "1").when(s == 2, "2").when(s <= 5, "3-5").when(s <= 10, "6-10").when(s <= 100, "11-100").when(s <= 1000, "101-1000").otherwise(">1000")
        return self.sizes().groupBy(kind.alias("size_class")).agg(F.count("*").alias("clusters"))

    def append(self, batch: DataFrame) -> RepDB:
        """The database after sketches (id, hashes, n) are added."""
        return self._append_mst(batch) if self.params["kind"] == "mst" else self._append_greedy(batch)

    def _near(self, ws: Workspace, batch: DataFrame) -> DataFrame:
        return ws.store(self.hits(batch).where(F.col("distance") <= self.params["threshold"]))

    def _append_greedy(self, batch: DataFrame) -> RepDB:
        """Items without an old representative near open clusters in the order of sketch size; each other item joins
        the nearest of the old representatives and of the new ones before it, at equal distance an old one."""
        ws = Workspace(self.spark, "repdb")
        near = self._near(ws, batch)
        rest = ws.store(batch.join(near.select(F.col("q").alias("id")), "id", "left_anti").select("id", "hashes", "n"))
        edges = ws.store(pairs.edges(pairs.pair_counts(batch), self.params["k"], metric=self.params["metric"], threshold=self.params["threshold"]))
        among = edges.join(rest.select(F.col("id").alias("i")), "i", "left_semi").join(rest.select(F.col("id").alias("j")), "j", "left_semi")
        new = ws.store(greedy.representatives(ws, ws.store(greedy.by_size(rest)), among).where("rep").select("id"))
        order = greedy.by_size(batch)
        both = edges.select(F.col("i").alias("id"), F.col("j").alias("r"), "dist").union(edges.select("j", "i", "dist")).join(new.select(F.col("id").alias("r")), "r", "left_semi")
        later = both.join(order.withColumnsRenamed({"id": "r", "place": "p"}), "r").join(order, "id").where("p < place").select("id", "r", "dist", F.lit(1).alias("age"), F.col("p.down").alias("down"))
        old = near.select(F.col("q").alias("id"), "r", F.col("distance").alias("dist"), F.lit(0).alias("age"), F.lit(0).cast("long").alias("down"))
        best = old.unionByName(later).groupBy("id").agg(F.min(F.struct("dist", "age", "down", "r")).alias("best"))
        of_rep = self.reps.select(F.col("rep").alias("r"), "cluster").union(new.select("id", F.col("id").alias("cluster")))
        joined = best.join(new, "id", "left_anti").select("id", F.col("best.r").alias("r")).join(of_rep, "r").select("id", "cluster")
        added = ws.store(joined.union(new.select("id", F.col("id").alias("cluster"))))
        reps = rest.join(new, "id", "left_semi").select(F.col("id").alias("rep"), F.col("id").alias("cluster"), "hashes", "n")
        ws.drop(near, edges)
        fresh = None if self.added else (reps, added)
        return RepDB(self.params, self.reps.unionByName(reps), self.members.unionByName(added), self.stored if fresh else None, fresh)

    def _append_mst(self, batch: DataFrame) -> RepDB:
        """New items, representatives and the pairs within the threshold form a graph; each of its components becomes one
        cluster, kept by its representative that is nearest to a new item, or by its largest new sketch."""
        ws = Workspace(self.spark, "repdb")
        near = self._near(ws, batch)
        among = pairs.edges(pairs.pair_counts(batch), self.params["k"], metric=self.params["metric"], threshold=self.params["threshold"])
        graph = near.select(F.concat(F.lit("n"), "q").alias("u"), F.concat(F.lit("r"), "r").alias("v")).union(among.select(F.concat(F.lit("n"), "i"), F.concat(F.lit("n"), "j")))
        part = ws.store(components(ws, graph))
        new = batch.select("id", "hashes", "n", F.concat(F.lit("n"), "id").alias("node")).join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component", "node"))
        old = self.reps.select("rep", "cluster", F.concat(F.lit("r"), "rep").alias("node")).join(part.withColumnRenamed("id", "node"), "node").select("rep", "cluster", F.col("component").alias("part"))
        closest = near.groupBy(F.col("r").alias("rep")).agg(F.min("distance").alias("d"))
        keeper = old.join(closest, "rep").groupBy("part").agg(F.min(F.struct("d", "rep", "cluster")).alias("k")).select("part", F.col("k.rep").alias("keep_rep"), F.col("k.cluster").alias("keep"))
        largest = new.groupBy("part").agg(F.min(F.struct((-F.col("n")).alias("down"), "id")).alias("k")).select("part", F.col("k.id").alias("first"))
        target = ws.store(largest.join(keeper, "part", "left").select("part", "first", "keep_rep", F.coalesce("keep", "first").alias("cluster")))
        moved = ws.store(old.join(target.select("part", F.col("cluster").alias("to"), "keep_rep"), "part").select("rep", "cluster", "to", "keep_rep"))
        retired = moved.where("rep <> keep_rep").select("rep")
        fresh = new.join(target.where("keep_rep is null"), "part").where("id = first").select(F.col("id").alias("rep"), "cluster", "hashes", "n")
        reps = self.reps.join(retired, "rep", "left_anti").select("rep", "cluster", "hashes", "n").unionByName(fresh)
        kept = self.members.join(moved.select("cluster", "to"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
        return RepDB(self.params, reps, kept.unionByName(new.join(target.select("part", "cluster"), "part").select("id", "cluster")))

    def save(self, path: str) -> int:
        """Write the next version under path and mark it; returns its number.

        Tables go to a folder of a name of its own, which the mark tells: what a failed save left is never met again.
        Where a loaded database has only grown, its old folders are named again and only what was added is written,
        until there are FOLDERS of them.
        """
        number, folder = max(versions(self.spark, path), default=0) + 1, uuid.uuid4().hex
        before = self.stored[1] if self.stored and self.stored[0] == path and self.added and len(self.stored[1]) < FOLDERS else ()
        reps, members = self.added if before else (self.reps, self.members)
        tables.save(f"{path}/{folder}", self.params, reps=reps, members=members)
        mark = self.spark.createDataFrame([(number, [*before, folder])], "version long, folders array<string>")
        mark.coalesce(1).write.parquet(f"{path}/marks/{folder}")
        return number


def versions(spark: SparkSession, path: str) -> dict[int, tuple[str, ...]]:
    """Number and folders of each version that is whole; of two writers of one number the smaller folder name counts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    done = spark._jvm.org.apache.hadoop.fs.Path
    whole = [str(s.getPath()) for s in files.listStatus(where) if files.exists(done(s.getPath(), "_SUCCESS"))]
    marks = spark.read.schema("version long, folders array<string>").parquet(*whole).collect() if whole else []
    return dict(sorted(((m.version, tuple(m.folders)) for m in marks), reverse=True))


def build(sketches: DataFrame, clusters: DataFrame, *, k: int, threshold: float, metric: str = "mash", kind: str = "greedy", reps: DataFrame | None = None) -> RepDB:
    """A database of clusters(id, cluster), each kept by its representative in reps(cluster, rep), else by its item `cluster`."""
    own = clusters.select("cluster").distinct()
    own = own.withColumn("rep", F.col("cluster")) if reps is None else own.join(reps, "cluster", "left").select("cluster", F.coalesce("rep", "cluster").alias("rep"))
    reps = sketches.join(own, F.col("id") == F.col("rep")).select("rep", "cluster", "hashes", "n")
    return RepDB({"k": k, "threshold": threshold, "metric": metric, "kind": kind}, reps, clusters.select("id", "cluster"))


def load(spark: SparkSession, path: str, version: int | None = None) -> RepDB:
    known = versions(spark, path)
    folders = known[version or max(known)]
    params, _ = tables.load(spark, f"{path}/{folders[-1]}")
    reps, members = (spark.read.parquet(*[f"{path}/{f}/{name}" for f in folders]) for name in ("reps", "members"))
    return RepDB(params, reps, members, (path, folders))


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch of sketches (id, hashes, n) to the database at path; returns the stream's writer.

    Batches are told by their ids among the members: a batch that is delivered again adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        db = load(batch.sparkSession, path)
        db.append(batch.dropDuplicates(["id"]).join(db.members.select("id"), "id", "left_anti").select("id", "hashes", "n")).save(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
