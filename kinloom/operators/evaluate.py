"""Clusters against known labels: purity, coverage, mutual information, F1, matching, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace


def contingency(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, label, c) of clustered(id, cluster) and truth(id, label); ids without a label are left out."""
    return clustered.select("id", "cluster").join(truth.where("label is not null").select("id", "label"), "id").groupBy("cluster", "label").agg(F.count("*").alias("c"))


def unmatched(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how many clustered ids have no label."""
    return clustered.select("id").join(truth.where("label is not null").select("id"), "id", "left_anti").agg(F.count("*").alias("n"))


def purity(table: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, total, dominant_label, dominant, purity) of clusters of `least` or more; ties to the smaller label."""
    by = table.groupBy("cluster").agg(F.sum("c").alias("total"), F.min(F.struct((-F.col("c")).alias("down"), "label")).alias("top")).where(F.col("total") >= least)
    return by.select("cluster", "total", F.col("top.label").alias("dominant_label"), (-F.col("top.down")).alias("dominant"), F.round(-F.col("top.down") / F.col("total"), 6).alias("purity"))


def overall_purity(table: DataFrame) -> DataFrame:
    by = table.groupBy("cluster").agg(F.max("c").alias("m"), F.sum("c").alias("t"))
    return by.agg(F.sum("t").alias("members"), F.round(F.sum("m") / F.sum("t"), 6).alias("purity"), F.round(F.sum(F.when(F.col("t") > 1, F.col("t")).otherwise(0)) / F.sum("t"), 6).alias("coverage"), F.round(F.min(F.col("m") / F.col("t")), 6).alias("min_purity"))


def outliers(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, id, label, is_dominant) of clusters with more than one label."""
    table = contingency(clustered, truth)
    top = purity(table).where("purity < 1").select("cluster", "dominant_label")
    return clustered.select("id", "cluster").join(truth, "id").join(top, "cluster").select("cluster", "id", "label", (F.col("label") == F.col("dominant_label")).alias("is_dominant"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: members, mutual information, both entropies, and the share by their arithmetic mean."""
    n = table.agg(F.sum("c").alias("n"))
    entropy = lambda by, name: table.groupBy(by).agg(F.sum("c").alias("t")).join(F.broadcast(n)).agg((-F.sum(F.col("t") / F.col("n") * F.log(F.col("t") / F.col("n")))).alias(name))
    rows, cols = table.groupBy("cluster").agg(F.sum("c").alias("a")), table.groupBy("label").agg(F.sum("c").alias("b"))
    joint = table.join(rows, "cluster").join(cols, "label").join(F.broadcast(n))
    mi = joint.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"), F.max("n").alias("members"))
    out = mi.join(F.broadcast(entropy("cluster", "h_cluster"))).join(F.broadcast(entropy("label", "h_label")))
    share = F.when(F.col("h_cluster") + F.col("h_label") > 0, 2 * F.col("mi") / (F.col("h_cluster") + F.col("h_label"))).otherwise(1.0)
    return out.select("members", *(F.round(c, 6).alias(c) for c in ("mi", "h_cluster", "h_label")), F.round(share, 6).alias("nmi"))


def matched_labels(ws: Workspace, table: DataFrame) -> DataFrame:
    """(cluster, label): each label goes to one cluster, which wants it most; null where none is left.

    Deferred acceptance in rounds: clusters propose to their next label, a label keeps the largest count and
    then the smaller cluster, the others go on.
    """
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "label"))
    wishes = ws.store(table.withColumn("place", place))
    state = ws.store(wishes.select("cluster").distinct().withColumn("at", F.lit(1)))
    while True:
        asked = state.join(wishes, (state.cluster == wishes.cluster) & (state["at"] == wishes.place)).select(wishes.cluster, "at", "label", "c")
        held = asked.groupBy("label").agg(F.min(F.struct((-F.col("c")).alias("down"), "cluster")).alias("best")).select("label", F.col("best.cluster").alias("holder"))
        lost = ws.store(asked.join(held, "label").where("cluster <> holder").select("cluster"))
        if lost.isEmpty():
            return state.select("cluster").join(asked.select("cluster", "label"), "cluster", "left")
        state = ws.store(state.join(lost.withColumn("l", F.lit(1)), "cluster", "left").select("cluster", (F.col("at") + F.coalesce("l", F.lit(0))).alias("at")))


def scores(table: DataFrame, matching: DataFrame) -> DataFrame:
    """One row: precision, recall and F1, weighted by the labels' sizes, of clusters named by matching(cluster, label)."""
    named = table.join(matching.select("cluster", F.col("label").alias("given")), "cluster", "left")
    true = named.groupBy("label").agg(F.sum("c").alias("size"), F.sum(F.when(F.col("given") == F.col("label"), F.col("c")).otherwise(0)).alias("hit"))
    told = named.where("given is not null").groupBy(F.col("given").alias("label")).agg(F.sum("c").alias("told"))
    by = true.join(told, "label", "left").withColumn("p", F.coalesce(F.try_divide("hit", "told"), F.lit(0.0))).withColumn("r", F.col("hit") / F.col("size"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    mean = lambda x, name: F.round(F.sum(x * F.col("size")) / F.sum("size"), 6).alias(name)
    return by.agg(mean(F.col("p"), "precision"), mean(F.col("r"), "recall"), mean(f1, "f1"))


def composition(table: DataFrame) -> DataFrame:
    """(cluster, total, n_labels, majority, majority_count, purity, is_mixed)."""
    by = table.groupBy("cluster").agg(F.sum("c").alias("total"), F.count("*").alias("n_labels"), F.min(F.struct((-F.col("c")).alias("down"), "label")).alias("top"))
    return by.select("cluster", "total", "n_labels", F.col("top.label").alias("majority"), (-F.col("top.down")).alias("majority_count"), F.round(-F.col("top.down") / F.col("total"), 6).alias("purity"), (F.col("n_labels") > 1).alias("is_mixed"))


def cooccurrence(table: DataFrame) -> DataFrame:
    """(label_a, label_b, n_clusters, members, kind) of labels that share clusters.

    kind, by the pair's shares of all members in those clusters: boundary_conflict where both have 0.3, purity
    is below 0.7 and 10 or more members are there; minority_outlier where one has 0.7 and the other is below 0.3.
    """
    sizes = table.groupBy("cluster").agg(F.sum("c").alias("t"), F.max("c").alias("m"))
    a = table.select("cluster", F.col("label").alias("label_a"), F.col("c").alias("ca"))
    b = table.select("cluster", F.col("label").alias("label_b"), F.col("c").alias("cb"))
    met = a.join(b, "cluster").where("label_a < label_b").join(sizes, "cluster")
    by = met.groupBy("label_a", "label_b").agg(F.count("*").alias("n_clusters"), F.sum("t").alias("members"), F.sum("ca").alias("a"), F.sum("cb").alias("b"), F.sum("m").alias("m"))
    low, high = F.least("a", "b") / F.col("members"), F.greatest("a", "b") / F.col("members")
    kind = F.when((low >= 0.3) & (F.col("m") / F.col("members") < 0.7) & (F.col("members") >= 10), "boundary_conflict").when((high >= 0.7) & (low < 0.3), "minority_outlier").otherwise("other")
    return by.select("label_a", "label_b", "n_clusters", "members", kind.alias("kind"))


def pair_clusters(table: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """(cluster, total, count_a, count_b, ratio_a, is_mixed, balance) of clusters that hold either label."""
    by = table.groupBy("cluster").agg(*(F.sum(F.when(F.col("label") == x, F.col("c")).otherwise(0)).alias(n) for x, n in ((label_a, "count_a"), (label_b, "count_b"))), F.sum("c").alias("total")).where("count_a + count_b > 0")
    ratio = F.col("count_a") / (F.col("count_a") + F.col("count_b"))
    mixed = (F.col("count_a") > 0) & (F.col("count_b") > 0)
    balance = F.when(~mixed, "single").when(F.least(ratio, 1 - ratio) >= 0.3, "balanced").otherwise("minority")
    return by.select("cluster", "total", "count_a", "count_b", F.round(ratio, 6).alias("ratio_a"), mixed.alias("is_mixed"), balance.alias("balance"))


def ancestor_at(spark, nodes: DataFrame, rank: str) -> DataFrame:
    """(id, ancestor): each taxon's nearest ancestor-or-self of a rank; nodes: id, parent, rank. Null where none is.

    Pointer doubling: a round doubles the levels looked at, until no taxon looks further up.
    """
    ws = Workspace(spark, "taxa")
    at = nodes.select("id", F.when(F.col("rank") == rank, F.col("id")).alias("ancestor"), F.when((F.col("rank") != rank) & (F.col("id") != F.col("parent")), F.col("parent")).alias("next"))
    at = ws.store(at)
    for _ in range(64):  # a circle of parents would never end
        if at.where("next is not null").isEmpty():
            break
        up = at.select(F.col("id").alias("next"), F.col("ancestor").alias("a"), F.col("next").alias("n"))
        after = ws.store(at.join(up, "next", "left").select("id", F.coalesce("ancestor", "a").alias("ancestor"), F.when(F.col("ancestor").isNull() & F.col("a").isNull(), F.col("n")).alias("next")))
        ws.drop(at)
        at = after
    return at.select("id", "ancestor")


def rank_agreement(table: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(cluster, label, c, dominant_label, agreement) of the labels of a cluster that aren't its dominant one.

    ancestors(id, ancestor): the labels' taxa of a rank. agreement: same, different, or unknown where neither has one.
    """
    top = purity(table, 1).select("cluster", "dominant_label")
    rest = table.join(top, "cluster").where("label <> dominant_label")
    of = lambda c, name: ancestors.select(F.col("id").alias(c), F.col("ancestor").alias(name))
    met = rest.join(of("label", "mine"), "label", "left").join(of("dominant_label", "theirs"), "dominant_label", "left")
    verdict = F.when(F.col("mine").isNull() & F.col("theirs").isNull(), "unknown").when(F.col("mine").eqNullSafe(F.col("theirs")), "same").otherwise("different")
    return met.select("cluster", "label", "c", "dominant_label", verdict.alias("agreement"))


def pure(table: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, total, label) of clusters of `least` or more with a single label."""
    return purity(table, least).where(F.col("dominant") == F.col("total")).select("cluster", "total", F.col("dominant_label").alias("label"))


def widest_pairs(table: DataFrame, most: int) -> DataFrame:
    """The `most` label pairs that share the most clusters, then members; ties by name."""
    return cooccurrence(table).orderBy(F.desc("n_clusters"), F.desc("members"), "label_a", "label_b").limit(most)


def status_counts(report: DataFrame, reps: DataFrame) -> DataFrame:
    """(status, n_reps, n_rest) of a report(accession, best_match_status) and reps(accession)."""
    marked = report.join(reps.select("accession").distinct().withColumn("r", F.lit(1)), "accession", "left")
    return marked.groupBy(F.col("best_match_status").alias("status")).agg(F.count_if(F.col("r").isNotNull()).alias("n_reps"), F.count_if(F.col("r").isNull()).alias("n_rest"))
