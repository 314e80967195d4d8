"""Steps whose work must not grow faster than their tables."""

import hashlib
import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import formulas, kmers, shingled
from kinloom.functions.durable import Workspace
from kinloom.operators import dbscan, graph, greedy, grid, near, pairs, sketch
from kinloom.operators.order import by_group
from kinloom.plans import catalog, steps


@pytest.fixture
def ws(spark):
    return Workspace(spark, "growth")


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles_by_the_batch_equal_the_expression(spark, monkeypatch, width):
    monkeypatch.setattr(shingled, "HELD", 300)
    draw = random.Random(width)
    words, gaps = ["a", "Bc", "Ünï", "ΣΑΣ", "İx", "x" * 60, "y" * 300, "ß", "q\u0085", "\u001f", "z", "日本", "Z" * 55, "w" * 53], ["", " ", "  ", "\t", " \n ", "\u000b", "\r\n"]
    rows = [(i, "".join(draw.choice(gaps) + draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(40)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "   "), (1003, "\na b c d e\n"), (1004, " a b c d e "), (1005, "a b c d e"), (1006, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_row = F.coalesce(kmers.distinct_hashes(kmers.word_shingles(F.col("text"), width)), F.array().cast("array<long>"))
    want = {r.doc_id: list(r.h) for r in docs.select("doc_id", by_row.alias("h")).collect()}
    assert {r.id: list(r.hashes) for r in sketch.shingle_sets(docs, "doc_id", "text", width).collect()} == want
    assert {r.id: list(r.hashes) for r in sketch.shingle_sets(docs, "doc_id", "text", width, 7).collect()} == {k: h[:7] for k, h in want.items()}


def test_sketches_leave_no_full_sets(spark, small):
    steps.forget(spark)
    steps.sketches(spark, small)
    assert [k[1] for k in steps._STORED] == ["sketches"]


def test_kmers_are_cut_from_runs_of_bases_only(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice("ACGT" * 8 + "NnxX ") for _ in range(draw.randrange(900))) for _ in range(40)] + ["", "ACGTACGTACG", "ACGTACGTACGT", "N" * 50, "acgt" * 200]
    paired = str.maketrans("ACGT", "TGCA")
    windows = lambda t: [t[i : i + 12] for i in range(len(t) - 11) if not set(t[i : i + 12]) - set("ACGT")]
    own = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", kmers.canonical_kmers(F.col("text"), 12).alias("x"))
    assert {r.id: list(r.x) for r in own.collect()} == {i: [min(x, x.translate(paired)[::-1]) for x in windows(t.upper())] for i, t in enumerate(texts)}
    plan = own._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" not in plan  # no window is cut only to be dropped


def test_hashes_of_any_length():
    data = bytes(random.Random(3).randrange(256) for _ in range(700))
    ends = list(range(0, 400, 7)) + [55, 56, 63, 64, 119, 120, 247, 248, 700]
    got = shingled.hashes60(shingled.np.frombuffer(data, shingled.np.uint8), shingled.np.zeros(len(ends), int), shingled.np.array(ends))
    assert got.tolist() == [int(hashlib.md5(data[:e]).hexdigest()[:15], 16) for e in ends]


def near_by_hand(rows, jaccard):
    """(i, j, common, n_i, n_j) of sets (id, hashes) whose Jaccard similarity reaches a bound."""
    out = []
    for (i, a), (j, b) in permutations(rows, 2):
        if j < i and a and len(set(a) & set(b)) >= math.ceil(jaccard / (1 + jaccard) * (len(a) + len(b)) - 1e-9) and set(a) & set(b):
            out.append((i, j, len(set(a) & set(b)), len(a), len(b)))
    return sorted(out)


@pytest.fixture
def crowd(spark):
    """A crowd of near copies, equal ones too, small sets and others."""
    draw = random.Random(11)
    whole, rows = draw.sample(range(10**6), 40), []
    for i in range(70):
        rows.append((i, sorted(draw.sample(whole, draw.randrange(22, 40)))))
    for i in range(70, 130):
        rows.append((i, sorted(draw.sample(range(10**6), draw.randrange(6)) + [whole[0]])))
    rows += [(i, rows[i - 130][1]) for i in range(130, 150)] + [(i, []) for i in range(150, 155)] + [(i, whole[:9]) for i in range(155, 175)]
    rows = [(i, sorted(set(h))) for i, h in rows]
    draw.shuffle(rows)
    return rows, spark.createDataFrame([(i, h, len(h)) for i, h in rows], "id long, hashes array<long>, n long").repartition(4)


@pytest.mark.parametrize("jaccard, block, pack", [(0.43, 2048, 512), (0.43, 16, 4), (0.7, 16, 1), (0.1, 7, 3)])
def test_near_counts_by_classes_and_blocks(spark, ws, monkeypatch, crowd, jaccard, block, pack):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "PACK", pack)
    rows, sets = crowd
    got = near.all_counts(ws, sets, jaccard).select("i", "j", "common", "n_i", "n_j").collect()
    assert sorted(map(tuple, got)) == near_by_hand(rows, jaccard)


def test_forest_greedy_and_density_by_classes(spark, ws, crowd):
    rows, sets = crowd
    classed = ws.store(near.classes(sets))
    own = ws.store(pairs.edges(near.counts(ws, near.representing(sets, classed), formulas.min_jaccard(0.1, 5)), 5, threshold=0.1))
    every = ws.store(pairs.edges(pairs.pair_counts(sets), 5, threshold=0.1))
    told = lambda df: sorted(map(str, df.collect()))
    assert told(graph.spanning_forest(ws, own).unionByName(near.class_edges(classed))) == told(graph.spanning_forest(ws, every))
    for order in (greedy.by_size, greedy.by_input):
        assert told(greedy.class_clusters(ws, sets, classed, own, order)) == told(greedy.greedy_clusters(ws, sets, every, order))
    assert told(dbscan.of_classes(ws, classed, own, min_points=3)) == told(dbscan.dbscan(ws, sets, every, min_points=3))
    some, few = near.of_some(classed, own, "id % 5 <> 0")
    rest = sets.where("id % 5 <> 0")
    assert told(greedy.class_clusters(ws, rest, some, few)) == told(greedy.greedy_clusters(ws, rest, every.where("i % 5 <> 0 and j % 5 <> 0")))


@pytest.mark.parametrize("name", ["components", "forest_edges", "dedup_groups", "dedup_medoids", "k_reps", "stability", "min_common", "array_intersections", "composition", "leiden"])
def test_near_queries_store_no_far_pairs(spark, small, name):
    steps.forget(spark)
    catalog.QUERIES[name](spark, small).collect()
    assert not {"counts", "distances", "forest"} & {k[1] for k in steps._STORED}


def test_groups_are_dealt_over_all_partitions(spark):
    rows = spark.createDataFrame([(g, x) for g in range(60) for x in range(g % 4 + 1)], "g long, x long")
    run = lambda own: own.groupby("g", as_index=False)["x"].sum()
    got = by_group(rows, "g", run, "g long, x long")
    assert sorted(map(tuple, got.collect())) == [(g, sum(range(g % 4 + 1))) for g in range(60)]
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def pairs_by_hand(rows, least=1):
    """(i, j, common, n_i, n_j) of sets (id, hashes) with `least` common hashes."""
    own = {i: set(h) for i, h in rows}
    return sorted((i, j, len(own[i] & own[j]), len(own[i]), len(own[j])) for i, j in permutations(own, 2) if j < i and len(own[i] & own[j]) >= least)


@pytest.mark.parametrize("held, few, rows_out", [(1 << 22, 2, 100_000), (1000, 2, 50)])
def test_all_pairs_in_blocks(spark, ws, monkeypatch, crowd, held, few, rows_out):
    for name, value in (("HELD", held), ("FEW", few), ("LEAST", 500), ("ROWS", rows_out)):
        monkeypatch.setattr(grid, name, value)
    rows, sets = crowd
    lists, told = ws.store(pairs.shared_lists(sets)), lambda df: sorted(map(str, df.collect()))
    every = grid.over(lists, grid.Pairs)
    assert sorted(map(tuple, every.collect())) == pairs_by_hand(rows)
    assert sorted(map(tuple, pairs.pair_counts(sets, least=9).collect())) == pairs_by_hand(rows, 9)
    edges = ws.store(pairs.edges(every, 5))
    assert told(pairs.nearest_of(lists, 3, 5)) == told(pairs.nearest(edges, 3))
    assert told(pairs.density_of(lists, 5)) == told(pairs.density(edges))
    assert told(pairs.kinds_of(lists, 5).groupBy(F.round("dist", 9).alias("d")).agg(F.sum("c").alias("c"))) == told(edges.groupBy(F.round("dist", 9).alias("d")).agg(F.count("*").alias("c")))
    assert told(graph.spanning_forest(ws, pairs.forest_candidates(lists, 5))) == told(graph.spanning_forest(ws, edges))


@pytest.mark.parametrize("name", ["topk_neighbors", "four_levels", "gap_candidates", "jaccard_pairs", "posting_cap"])
def test_pairs_are_not_stored_or_joined(spark, small, name):
    steps.forget(spark)
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert not {"counts", "distances"} & {k[1] for k in steps._STORED}
    assert name == "gap_candidates" or "Join" not in plan
