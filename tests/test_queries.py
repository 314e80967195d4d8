import duckdb
import pytest

import __spark_entry__ as entry
from kinloom.plans import catalog, steps

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = catalog.oracle_sql()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([float(r[i]) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else None if r[i] is None else str(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    rows = [tuple(r) for r in got.collect()]
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        assert plain(rows, got.columns) == plain(want.fetchall(), [d[0] for d in want.description])


def test_trees_hold_all_candidate_pairs(spark, small):
    root, want = {}, []

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in sorted(steps.distances(spark, small).collect(), key=lambda r: (r.dist, r.j, r.i)):
        a, b = top(r.i), top(r.j)
        if a != b:
            root[a] = b
            want.append(round(r.dist, 6))
    got = [r.dist for r in catalog.linkage(spark, small).collect()]
    assert max(want) > 0.2 and sorted(got) == pytest.approx(sorted(want), abs=2e-6)
    assert sum(r.leaves - 1 for r in catalog.newick(spark, small).collect()) == len(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "cluster", "size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
