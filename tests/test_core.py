import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import durable, formulas, kmers
from kinloom.functions.durable import Workspace
from kinloom.operators import community, dbscan, evaluate, graph, greedy, pairs, postprocess, sketch, trees
from kinloom.sources import clusterfile, fasta, simulate, tables
from kinloom.streaming import repdb


@pytest.fixture
def ws(spark):
    return Workspace(spark, "test")


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def random_graph(spark, n, m, seed, top=0.1):
    draw = random.Random(seed)
    rows = {(max(a, b), min(a, b)): round(draw.uniform(0.001, top), 3) for a, b in (draw.sample(range(n), 2) for _ in range(m))}
    return rows, spark.createDataFrame([(i, j, d) for (i, j), d in rows.items()], "i long, j long, dist double")


def united(n, pairs):
    part = list(range(n))
    for a, b in pairs:
        a, b = part[a], part[b]
        part = [min(a, b) if x in (a, b) else x for x in part]
    return part


@pytest.mark.parametrize(("c", "a", "b", "jaccard", "mash", "aaf"), [(10, 10, 10, 1.0, 0.0, 0.0), (0, 10, 10, 0.0, 1.0, 1.0), (5, 10, 10, 1 / 3, math.log(2) / 20, math.log(2) / 20), (10, 10, 40, 0.25, -math.log(0.4) / 20, 0.0)])
def test_formulas(spark, c, a, b, jaccard, mash, aaf):
    c, a, b = F.lit(c), F.lit(a), F.lit(b)
    assert value(spark, formulas.jaccard(c, a, b)) == pytest.approx(jaccard)
    assert value(spark, formulas.mash_distance(c, a, b, 20)) == pytest.approx(mash)
    assert value(spark, formulas.aaf_distance(c, a, b, 20)) == pytest.approx(aaf)


def test_bounds_and_buckets(spark):
    assert formulas.max_size_ratio(0.05, 20) == pytest.approx(4.4366, abs=1e-3)
    assert [value(spark, formulas.ani_bucket(F.lit(d))) for d in (0.0, 0.005, 1.0, 1.3)] == [100, 99, 0, 0]
    assert [value(spark, formulas.density_bucket(F.lit(d))) for d in (0.0, 0.01, 0.0101)] == [0, 1, 2]
    assert [value(spark, formulas.level(F.lit(d))) for d in (0.0, 0.02, 0.5)] == ["identical", "species", "higher"]


def test_canonical_kmers_cross_blocks(spark):
    draw = random.Random(1)
    s = "".join(draw.choice("ACGTN" if i % 50 == 0 else "acgt") for i in range(1500))
    got = value(spark, kmers.canonical_kmers(F.lit(s), 9))
    turn = str.maketrans("ACGT", "TGCA")
    own = [s.upper()[i : i + 9] for i in range(len(s) - 8)]
    assert got == [min(x, x[::-1].translate(turn)) for x in own if "N" not in x]


def test_empty_sketches_stay_single(spark, ws):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c  d e f"), (3, "a b"), (4, None), (5, "")], "doc_id long, text string")
    own = ws.store(sketch.bottom(sketch.shingle_sets(docs, "doc_id", "text", 5), 10))
    assert {r.id: r.n for r in own.collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}
    edges = pairs.edges(pairs.pair_counts(own), 5, threshold=0.1)
    assert {r.id: r.cluster for r in graph.clusters(ws, own, edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_and_components(spark, ws, seed):
    n = 40
    rows, edges = random_graph(spark, n, 70, seed)
    best, part = [], list(range(n))
    for (i, j), d in sorted(rows.items(), key=lambda x: (x[1], x[0][1], x[0][0])):
        if part[i] != part[j]:
            best.append((i, j, d))
            part = [min(part[i], part[j]) if x in (part[i], part[j]) else x for x in part]
    forest = ws.store(graph.spanning_forest(ws, edges))
    assert sorted(map(tuple, forest.collect())) == sorted(best)
    nodes = spark.range(n)
    near = united(n, [e for e, d in rows.items() if d <= 0.04])
    assert [r.cluster for r in graph.clusters(ws, nodes, graph.cut(forest, 0.04)).orderBy("id").collect()] == near


@pytest.mark.parametrize("most", [graph.ONE_TASK, 3])
def test_components_by_one_task_or_by_rounds(spark, ws, monkeypatch, most):
    monkeypatch.setattr(graph, "ONE_TASK", most)
    draw = random.Random(most)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k + 1, k) for k in range(400, 700)] + [(7, 7), (900, 900)]
    tables = ws.n
    found = graph.components(ws, spark.createDataFrame(edges, "u long, v long").repartition(5))
    assert most == 3 or ws.n - tables == 2  # few edges take no round of joins
    part = united(901, edges)
    assert sorted(map(tuple, found.select("id", "component").collect())) == [(i, part[i]) for i in sorted({x for e in edges if e[0] != e[1] for x in e})]


def test_driver_gives_native_memory_back(spark, ws, monkeypatch):
    assert durable.trimmed(spark)
    calls = []
    monkeypatch.setattr(durable, "trimmed", calls.append)
    ws.store(spark.range(3))
    assert calls == [spark]


def test_empty_graph(spark, ws):
    none = spark.createDataFrame([], "i long, j long, dist double")
    assert graph.spanning_forest(ws, none).count() == 0
    assert graph.clusters(ws, spark.range(3), none).count() == 3


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_equals_serial(spark, ws, seed):
    n, draw = 30, random.Random(seed)
    rows, edges = random_graph(spark, n, 60, seed)
    sizes = [draw.randint(1, 5) for _ in range(n)]
    near = {}
    for (i, j), d in rows.items():
        near.setdefault(i, {})[j] = near.setdefault(j, {})[i] = d
    want, order = {}, sorted(range(n), key=lambda v: (-sizes[v], v))
    for at, v in enumerate(order):
        reps = [u for u in order[:at] if want[u] == u and u in near.get(v, {})]
        want[v] = min(reps, key=lambda u: (near[v][u], -sizes[u], u)) if reps else v
    sketches = spark.createDataFrame([(v, [], sizes[v]) for v in range(n)], "id long, hashes array<long>, n long")
    assert {r.id: r.cluster for r in greedy.greedy_clusters(ws, sketches, edges).collect()} == want


def test_dbscan_border_and_noise(spark, ws):
    edges = spark.createDataFrame([(2, 1, 0.1), (3, 2, 0.1), (3, 1, 0.1), (4, 3, 0.1), (6, 5, 0.1)], "i long, j long, dist double")
    got = {r.id: (r.cluster, r.is_core, r.is_noise) for r in dbscan.dbscan(ws, spark.range(1, 8), edges, min_points=3).collect()}
    assert got == {1: (1, True, False), 2: (1, True, False), 3: (1, True, False), 4: (1, False, False), 5: (None, False, True), 6: (None, False, True), 7: (None, False, True)}


def test_communities_of_two_cliques(spark, ws):
    edges = [(i, j, 0.1) for g in (range(5), range(5, 10)) for j, i in combinations(g, 2)] + [(5, 4, 0.9)]
    df = spark.createDataFrame(edges, "i long, j long, dist double")
    for found in (community.louvain(ws, spark.range(11), df), community.leiden(ws, spark.range(11), df)):
        assert [r.community for r in found.orderBy("id").collect()] == [0] * 5 + [5] * 5 + [10]


def test_trees(spark, ws):
    chain = spark.createDataFrame([(2, 1, 0.01), (3, 2, 0.02), (4, 3, 0.03)], "i long, j long, dist double")
    assert [tuple(r)[2:] for r in trees.linkage(ws, chain).orderBy("step").collect()] == [(1, 2, 0.01, 2), (1, 3, 0.02, 3), (1, 4, 0.03, 4)]
    tree = trees.newick(ws, chain).first()
    assert (tree.leaves, tree.tree) == (4, "(((1:0.010000,2:0.010000):0.010000,3:0.020000):0.010000,4:0.030000);")
    lengths = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 5)], "id long, length long")
    assert trees.medoids(ws, chain, lengths).first().rep == 3
    assert sorted(r.rep for r in trees.k_representatives(ws, chain, 2).collect()) == [1, 4]
    assert trees.nexus(trees.newick(ws, chain)).first().tree.startswith("#NEXUS")
    own = {r.id: r.rep for r in postprocess.dedup_groups(ws, spark.range(1, 6), chain, lengths, 0.02).collect()}
    assert own == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}


def test_evaluation(spark, ws):
    clustered = spark.createDataFrame([(i, i // 4) for i in range(8)], "id long, cluster long")
    truth = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(8)], "id long, label string")
    table = ws.store(evaluate.contingency(clustered, truth))
    assert evaluate.overall_purity(table).first().purity == 0.875
    assert {r.cluster: r.label for r in evaluate.matched_labels(ws, table).collect()} == {0: "a", 1: "b"}
    assert evaluate.mutual_information(evaluate.contingency(clustered, clustered.select("id", F.col("cluster").cast("string").alias("label")))).first().nmi == 1.0
    nodes = spark.createDataFrame([(1, 1, "root"), (2, 1, "genus"), (3, 2, "species"), (4, 3, "strain")], "id long, parent long, rank string")
    assert {r.id: r.ancestor for r in evaluate.ancestor_at(spark, nodes, "genus").collect()} == {1: None, 2: 2, 3: 2, 4: 2}


def test_database_appends(spark, ws, tmp_path):
    sets = spark.createDataFrame([(1, list(range(10)), 10), (2, list(range(20, 30)), 10)], "id long, hashes array<long>, n long")
    clusters = spark.createDataFrame([(1, 1), (2, 2)], "id long, cluster long")
    bridge = spark.createDataFrame([(9, [*range(6), *range(20, 26)], 12), (10, [99], 1)], "id long, hashes array<long>, n long")
    where = f"file://{tmp_path}/db"
    for kind, want in (("greedy", {1: 1, 2: 2, 9: 1, 10: 10}), ("mst", {1: 1, 2: 1, 9: 1, 10: 10})):
        db = repdb.build(sets, clusters, k=5, threshold=0.3, kind=kind)
        number = db.append(bridge).save(where)
        back = repdb.load(spark, where)
        assert {r.id: r.cluster for r in back.members.collect()} == want and max(repdb.versions(spark, where)) == number
    asked = {r.query: (r.rank, r.rep) for r in back.query(bridge, 1).collect()}
    assert asked == {9: (1, 1), 10: (1, 10)}
    far = spark.createDataFrame([(50, [777], 1)], "id long, hashes array<long>, n long")
    assert back.assign(far).first().status == "novel" and back.query(far).first()["rank"] == 0


def test_files_round_trip(spark, ws, tmp_path):
    (tmp_path / "a.fna").write_text(">s1 first one\nACGT\nAC\n>s2\nTTTT\n")
    got = [tuple(r)[1:] for r in fasta.read_fasta(spark, f"file://{tmp_path}/a.fna").orderBy("name").collect()]
    assert got == [("s1", "first one", "ACGTAC", 6), ("s2", "noComment", "TTTT", 4)]
    assert fasta.numbered(fasta.read_fasta(spark, f"file://{tmp_path}/a.fna"), by_file=True, least=5).first().length == 10
    members = spark.createDataFrame([(1, 1, 6, "a.fna", "s1", "x"), (1, 3, 4, "a.fna", "s2", None), (2, 2, 4, "b.fna", "s3", "y")], "cluster long, id long, length long, file string, name string, comment string")
    clusterfile.write_clusters(members, f"file://{tmp_path}/out", threshold=0.05)
    assert clusterfile.looks_like_clusters(spark, f"file://{tmp_path}/out")
    back = clusterfile.read_clusters(spark, f"file://{tmp_path}/out").orderBy("cluster", "place")
    assert [tuple(r) for r in back.collect()] == [(0, 0, 1, 6, "a.fna", "s1", "x"), (0, 1, 3, 4, "a.fna", "s2", "N/A"), (1, 0, 2, 4, "b.fna", "s3", "y")]
    edges = spark.createDataFrame([(2, 1, 0.25)], "i long, j long, dist double")
    tables.save_graph(edges, f"file://{tmp_path}/graph")
    assert [tuple(r) for r in tables.saved_graph(spark, f"file://{tmp_path}/graph").collect()] == [(2, 1, 0.25)]
    (tmp_path / "truth").write_text("name taxid organism\ns1 7 A b\ns1 8 C\ns2 9 D\n")
    assert {r.key: r.label for r in tables.ground_truth(spark, f"file://{tmp_path}/truth").collect()} == {"s1": "7", "s2": "9"}


def test_planted_clusters_are_found(spark, ws):
    own = ws.store(simulate.mutated(spark, 3, 4, 800, 0.005))
    sets = ws.store(sketch.kmer_sets(own, "id", F.col("sequence"), 15))
    found = graph.clusters(ws, sets, ws.store(pairs.edges(pairs.pair_counts(sets), 15, threshold=0.05)))
    assert {(r.id, r.cluster // 4) for r in found.collect()} == {(i, i // 4) for i in range(12)}


def test_leiden_communities_are_connected_and_no_move_gains():
    from kinloom.operators import community

    for seed in range(30):
        r = random.Random(seed)
        n = r.randint(4, 24)
        edges = [(j, i, r.random()) for i, j in combinations(range(n), 2) if r.random() < 0.25]
        if not edges:
            continue
        got = community.communities(edges, 1.0, 0.3, True, True)
        near = {v: {} for v in got}
        for i, j, w in edges:
            near[i][j] = near[j][i] = w
        for c in set(got.values()):
            own = {v for v in got if got[v] == c}
            seen, stack = {min(own)}, [min(own)]
            while stack:
                for u in near[stack.pop()]:
                    if u in own - seen:
                        seen.add(u)
                        stack.append(u)
            assert seen == own and c == min(own)
        quality = lambda part: sum(w for i, j, w in edges if part[i] == part[j]) - 0.3 * sum(x * (x - 1) / 2 for x in [sum(p == c for p in part.values()) for c in set(part.values())])
        assert quality(got) >= quality({v: v for v in got}) - 1e-9
        plain = community.communities(edges, 1.0, 0.3, True, False)
        assert quality(got) >= quality(community._pieces(near, plain)) - 0.35 * abs(quality(plain))


def test_commands_from_files_to_database(spark, tmp_path):
    from kinloom import commands
    from kinloom.sources import clusterfile
    from kinloom.streaming import repdb

    r = random.Random(3)
    change = lambda s: "".join(r.choice("ACGT") if r.random() < 0.003 else c for c in s)
    seeds = ["".join(r.choice("ACGT") for _ in range(1500)) for _ in range(4)]
    for i, s in enumerate(seeds):
        for j in range(3):
            (tmp_path / f"g{i}_{j}.fna").write_text(f">s{i}_{j} made\n{change(s)}\n")
    first = [f"file://{tmp_path}/g{i}_{j}.fna" for i in range(3) for j in range(3)]
    out = f"file://{tmp_path}/out"
    found = commands.cluster(spark, first, out, method="mst", threshold=0.05, least=1000, k=15, size=400, newick=True, report=True)
    sizes = sorted(x["count"] for x in found.groupBy("cluster").count().collect())
    assert sizes == [3, 3, 3] and clusterfile.read_clusters(spark, out).count() == 9
    more = [f"file://{tmp_path}/g3_{j}.fna" for j in range(3)] + first[:1]
    grown = commands.append(spark, f"{out}.state", more, f"{out}2", least=1000)
    assert sorted(x["count"] for x in grown.groupBy("cluster").count().collect()) == [3, 3, 3, 3]
    kept = {x.id: x.cluster for x in found.collect()}
    assert kept.items() <= {x.id: x.cluster for x in grown.collect()}.items()
    for method in ("greedy", "dbscan", "louvain", "leiden"):
        again = commands.recluster(spark, f"{out}2.state", f"{out}-{method}", method=method, min_points=2, resolution=0.05 if method == "leiden" else 1.0)
        assert sorted(x["count"] for x in again.groupBy("cluster").count().collect()) == [3, 3, 3, 3], method
    commands.build(spark, f"{out}2.state", f"{out}.db")
    db = repdb.load(spark, f"{out}.db")
    answer = db.assign(commands.asked(spark, f"{out}2.state", more[:2], least=1000)).collect()
    assert {x.status for x in answer} == {"assigned"} and {x.cluster_size for x in answer} == {3}
    with pytest.raises(ValueError):
        commands.items(spark, "x.txt", by_file=False)


def test_save_after_a_failed_one(spark, tmp_path):
    from kinloom.streaming import repdb

    sets = spark.createDataFrame([(1, [1, 2, 3], 3), (2, [7, 8, 9], 3)], "id long, hashes array<long>, n long")
    db = repdb.build(sets, spark.createDataFrame([(1, 1), (2, 2)], "id long, cluster long"), k=5, threshold=0.1)
    where = f"file://{tmp_path}/db"
    db.save(where)
    half = db.append(spark.createDataFrame([(3, [20, 21], 2)], "id long, hashes array<long>, n long"))
    broken = repdb.RepDB(half.params, half.reps, half.members.selectExpr("id", "if(id = 3, raise_error('lost'), cluster) AS cluster"))
    with pytest.raises(Exception, match="lost"):
        broken.save(where)
    assert repdb.load(spark, where).members.count() == 2
    assert half.save(where) == 2 and repdb.load(spark, where).members.count() == 3


def test_greedy_append_takes_the_nearest_of_old_and_new(spark):
    from kinloom.streaming import repdb

    old = spark.createDataFrame([(1, list(range(0, 100)), 100)], "id long, hashes array<long>, n long")
    db = repdb.build(old, spark.createDataFrame([(1, 1)], "id long, cluster long"), k=5, threshold=0.15)
    # 10 is far from 1; 11 is near both and nearer to 10
    new = spark.createDataFrame([(10, list(range(60, 161)), 101), (11, list(range(35, 130)), 95)], "id long, hashes array<long>, n long")
    got = {x.id: x.cluster for x in db.append(new).members.collect()}
    assert got == {1: 1, 10: 10, 11: 10}


def test_stability_below_two_percent(spark):
    from kinloom.operators import thresholds

    edges = spark.createDataFrame([(k + 1, k, 0.005 + 0.0001 * k) for k in range(200)], "i long, j long, dist double")
    found = thresholds.stability(edges, 0.015)
    assert found["near_edges"] > 0 and 0 < found["stability"] < 1


def test_numbers_in_order(spark):
    from kinloom.functions.durable import Workspace
    from kinloom.operators.order import numbered

    r = random.Random(5)
    values = [r.randint(0, 50) for _ in range(500)]
    rows, n = numbered(Workspace(spark, "test"), spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7), "v", "i")
    want = {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {x.i: x.r for x in rows.collect()} == want and n.first().n == 500


def test_matching_has_no_pair_that_both_prefer_and_scores_follow(spark):
    from kinloom.functions.durable import Workspace
    from kinloom.operators import evaluate

    r = random.Random(12)
    rows = [(c, f"l{x}", r.randint(1, 6)) for c in range(9) for x in range(7) if r.random() < 0.5]
    table = spark.createDataFrame(rows, "cluster long, label string, c long")
    matching = evaluate.matched_labels(Workspace(spark, "test"), table)
    got = {x.cluster: x.label for x in matching.collect()}
    count = {(c, x): n for c, x, n in rows}
    holder = {x: c for c, x in got.items() if x is not None}
    assert len(holder) == sum(x is not None for x in got.values()) and set(got) == {c for c, _, _ in rows}
    for (c, x), n in count.items():
        mine, other = got[c], holder.get(x)
        wants = mine is None or (-n, x) < (-count[c, mine], mine)
        wanted = other is None or (-n, c) < (-count[other, x], other)
        assert mine == x or not (wants and wanted), (c, x)
    size = {x: sum(n for (_, y), n in count.items() if y == x) for _, x, _ in rows}
    total, want = sum(size.values()), [0.0, 0.0, 0.0]
    for x, n in size.items():
        c = holder.get(x)
        hit = count[c, x] if c is not None else 0
        told = sum(m for (d, _), m in count.items() if d == c) if c is not None else 0
        p, q = (hit / told if told else 0.0), hit / n
        for k, v in enumerate((p, q, 2 * p * q / (p + q) if p + q else 0.0)):
            want[k] += v * n / total
    assert list(evaluate.scores(table, matching).first()) == pytest.approx(want, abs=1e-6)
