"""DuckDB SQL that the queries' results are held against: common tables, put before a query's own SELECT."""

from __future__ import annotations

_TUNED = """
SELECT n, k_recommended::BIGINT AS k_recommended, k_least::BIGINT AS k_least, k::BIGINT AS k, sketch_size::BIGINT AS sketch_size, round(-ln(2 * (1 / sketch_size) / (1 + 1 / sketch_size)) / k, 6) AS max_distance, round(-ln(2 * (1 / sketch_size) / (1 + 1 / sketch_size)) / k, 6) >= 0.05 AS threshold_ok
FROM (SELECT *, CASE WHEN 21 < k_least OR 21 > k_recommended + 3 THEN k_recommended ELSE 21 END AS k, {size} AS sketch_size
FROM (SELECT count(n_chars) AS n, avg(n_chars) AS a, ceil(ln(max(n_chars) * 0.9999::DOUBLE / 1e-4) / ln(4.0) - 1e-9) AS k_recommended, ceil(ln(max(n_chars) * 0.99::DOUBLE / 1e-2) / ln(4.0) - 1e-9) AS k_least FROM documents))"""
TUNED = _TUNED.format(size="1000::DOUBLE")
TUNED_COMPRESSED = _TUNED.format(size="greatest(1, floor(round(a, 6) / 16))::DOUBLE")


def _hash(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def _sets(name: str, table: str, id: str) -> str:
    return f"""
{name}w AS (SELECT {id} AS id, regexp_split_to_array(trim(text), '\\s+') AS w FROM {table}),
{name}full_set AS MATERIALIZED (SELECT DISTINCT id, {_hash("lower(array_to_string(w[p:p + 4], ' '))")} AS hash FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS p FROM {name}w WHERE len(w) >= 5)),
{name}sk AS MATERIALIZED (SELECT id, hash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hash) AS r FROM {name}full_set) WHERE r <= 200),
{name}sz AS MATERIALIZED (SELECT id, count(*) AS n FROM {name}sk GROUP BY id)"""


_DIST = "CASE WHEN jac >= 1 THEN 0.0 ELSE least(1.0, -ln(2 * jac / (1 + jac)) / 5) END"


def _reach(name: str, edges: str) -> str:
    """All pairs (a, b) that edges(a, b) connect, each with itself."""
    return f"{name}(a, b) AS (SELECT DISTINCT a, a FROM {edges} UNION SELECT r.a, x.b FROM {name} r JOIN {edges} x ON r.b = x.a)"


_BASE = f"""WITH RECURSIVE {_sets("", "documents", "doc_id")},
pcs AS MATERIALIZED (SELECT i, j, common, x.n AS n_i, y.n AS n_j FROM (SELECT b.id AS i, a.id AS j, count(*) AS common FROM sk a JOIN sk b ON a.hash = b.hash AND a.id < b.id GROUP BY ALL) JOIN sz x ON x.id = i JOIN sz y ON y.id = j),
pj AS (SELECT *, common::DOUBLE / (n_i + n_j - common) AS jac FROM pcs),
e AS MATERIALIZED (SELECT i, j, {_DIST} AS dist FROM pj),
both_e AS MATERIALIZED (SELECT i AS a, j AS b, dist FROM e UNION ALL SELECT j, i, dist FROM e),
both_near AS MATERIALIZED (SELECT * FROM both_e WHERE dist <= 0.1),
both_dup AS MATERIALIZED (SELECT * FROM both_e WHERE dist <= 0.02),
{_reach("reach", "both_near")}, {_reach("reach_dup", "both_dup")},
cl AS MATERIALIZED (SELECT doc_id AS id, coalesce(c, doc_id) AS cluster FROM documents LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id))"""

#: An edge is in the forest if edges before it in the order (dist, j, i) don't connect its ends.
_FOREST = """,
grown(i, j, dist, node) AS (SELECT a, b, dist, b FROM both_e WHERE a > b UNION SELECT m.i, m.j, m.dist, x.b FROM grown m JOIN both_e x ON m.node = x.a AND (x.dist < m.dist OR x.dist = m.dist AND (least(x.a, x.b) < m.j OR least(x.a, x.b) = m.j AND greatest(x.a, x.b) < m.i))),
msf AS MATERIALIZED (SELECT i, j, min(dist) AS dist FROM grown GROUP BY i, j HAVING NOT bool_or(node = i)),
ranked AS MATERIALIZED (SELECT i, round(dist, 9) AS dist, row_number() OVER (ORDER BY dist, j, i) - 1 AS r, count(*) OVER () AS n FROM msf WHERE dist > 1e-10)"""


def base(select: str) -> str:
    return f"{_BASE}\n{select}"


def forest(select: str) -> str:
    return f"{_BASE}{_FOREST}\n{select}"


#: Candidates by gaps, then by quartiles that are inside the range and not close to one before them.
_CANDIDATES = """,
s AS MATERIALIZED (SELECT round(min(dist), 6) AS lo, round(max(dist), 6) AS hi, round(max(dist) FILTER (r = n // 4), 6) AS q1, round((max(dist) FILTER (r = n // 2) + max(dist) FILTER (r = (n - 1) // 2)) / 2, 6) AS q2, round(max(dist) FILTER (r = least(n - 1, 3 * n // 4)), 6) AS q3 FROM ranked),
g AS MATERIALIZED (SELECT round(dist, 6) AS t, round(gap, 6) AS gap_score, round(least(1.0, 10 * gap / range), 6) AS confidence FROM (SELECT *, dist - lag(dist) OVER (ORDER BY r) AS gap, max(dist) OVER () - min(dist) OVER () AS range FROM ranked) WHERE gap > range * 0.05 ORDER BY gap DESC, r LIMIT 5),
c1 AS MATERIALIZED (SELECT * FROM g UNION ALL SELECT q1, 0.0, 0.4 FROM s WHERE q1 >= 0.001 AND lo < q1 AND q1 < hi AND NOT EXISTS (SELECT 1 FROM g WHERE abs(q1 - t) < (hi - lo) * 0.05 * 0.5)),
c2 AS MATERIALIZED (SELECT * FROM c1 UNION ALL SELECT q2, 0.0, 0.4 FROM s WHERE q2 >= 0.001 AND lo < q2 AND q2 < hi AND NOT EXISTS (SELECT 1 FROM c1 WHERE abs(q2 - t) < (hi - lo) * 0.05 * 0.5)),
c3 AS MATERIALIZED (SELECT * FROM c2 UNION ALL SELECT q3, 0.0, 0.4 FROM s WHERE q3 >= 0.001 AND lo < q3 AND q3 < hi AND NOT EXISTS (SELECT 1 FROM c2 WHERE abs(q3 - t) < (hi - lo) * 0.05 * 0.5)),
candidates AS MATERIALIZED (SELECT t AS threshold, gap_score, confidence, CASE WHEN t < 0.001 THEN 'identical' WHEN t < 0.005 THEN 'strain/subspecies' WHEN t < 0.01 THEN 'strain' WHEN t < 0.03 THEN 'species' WHEN t < 0.1 THEN 'genus' WHEN t < 0.2 THEN 'family' ELSE 'higher' END AS level FROM c3),
optimal AS MATERIALIZED (SELECT * FROM candidates WHERE threshold >= 0.001 ORDER BY confidence * CASE WHEN threshold BETWEEN 0.01 AND 0.1 THEN 2.0::DOUBLE WHEN threshold >= 0.001 AND threshold < 0.01 THEN 1.2::DOUBLE WHEN threshold > 0.1 AND threshold <= 0.2 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END + 20 * gap_score DESC, threshold LIMIT 1)"""


def candidates(select: str) -> str:
    return f"{_BASE}{_FOREST}{_CANDIDATES}\n{select}"


def chosen_clusters(select: str) -> str:
    return f"""{_BASE}{_FOREST}{_CANDIDATES},
both_auto AS MATERIALIZED (SELECT * FROM both_e WHERE dist <= (SELECT threshold FROM optimal)),
{_reach("reach_auto", "both_auto")}
{select}"""


#: Widths around 0.1 until 100 forest edges are near, five thresholds across it, edges that change sides.
STABILITY = _BASE + _FOREST + """,
widths AS (SELECT unnest([1, 2, 3, 4]) AS k, unnest([0.01::DOUBLE, 0.015, 0.0225, 0.03375]) AS w),
counted AS (SELECT k, greatest(0, 0.1::DOUBLE - w) AS lo, 0.1::DOUBLE + w AS hi, (SELECT count(*) FROM msf WHERE dist BETWEEN greatest(0, 0.1::DOUBLE - w) AND 0.1::DOUBLE + w) AS near FROM widths),
used AS MATERIALIZED (SELECT * FROM counted WHERE k = coalesce((SELECT min(k) FROM counted WHERE near >= 100), 4)),
five AS (SELECT i, lo + (hi - lo) * i / 4 AS t, near FROM used, range(5) x(i)),
keep AS (SELECT i, t, near, 1 - (SELECT count(*) FROM msf WHERE dist > least(t, 0.1::DOUBLE) AND dist <= greatest(t, 0.1::DOUBLE)) / near AS k FROM five)
SELECT CASE WHEN near = 0 THEN 1 ELSE round(least(a, b), 6) END AS stability, CASE WHEN near = 0 THEN 1 ELSE round(a, 6) END AS split, CASE WHEN near = 0 THEN 1 ELSE round(b, 6) END AS merge, near AS near_edges FROM (SELECT coalesce(avg(k) FILTER (t < 0.1::DOUBLE), 0.5) AS a, coalesce(avg(k) FILTER (t > 0.1::DOUBLE), 0.5) AS b, max(near) AS near FROM keep)"""


def forest_reach(select: str) -> str:
    return f"""{_BASE}{_FOREST},
{_reach("reach_e", "both_e")}
{select}"""


def _greedy(where: str, of: str = "", order: str = "coalesce(n, 0) DESC, doc_id") -> str:
    """Items one by one in an order, by sketch size at first: a list grows by each that has no representative near."""
    return f""",
{of}items AS MATERIALIZED (SELECT doc_id AS id, coalesce(n, 0) AS n, row_number() OVER (ORDER BY {order}) AS place FROM documents LEFT JOIN sz ON sz.id = doc_id WHERE {where.format("doc_id")}),
{of}near AS MATERIALIZED (SELECT a, b, dist FROM both_near WHERE {where.format("a")} AND {where.format("b")}),
{of}turn AS MATERIALIZED (SELECT id, list(b) AS nb, row_number() OVER (ORDER BY any_value(place)) AS k FROM {of}items JOIN {of}near ON a = id GROUP BY id),
{of}picked(k, reps) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT p.k + 1, CASE WHEN list_has_any(t.nb, p.reps) THEN p.reps ELSE list_append(p.reps, t.id) END FROM {of}picked p JOIN {of}turn t ON t.k = p.k + 1),
{of}reps_all AS MATERIALIZED (SELECT unnest(reps) AS id FROM {of}picked WHERE k = (SELECT max(k) FROM {of}picked) UNION ALL SELECT id FROM {of}items WHERE id NOT IN (SELECT id FROM {of}turn)),
{of}best AS (SELECT a AS id, first(b ORDER BY dist, q.place) AS cluster, min(dist) AS dist FROM {of}near JOIN {of}items p ON p.id = a JOIN {of}items q ON q.id = b WHERE q.place < p.place AND b IN (SELECT id FROM {of}reps_all) GROUP BY a),
{of}assigned AS MATERIALIZED (SELECT i.id, CASE WHEN r.id IS NOT NULL THEN i.id ELSE best.cluster END AS cluster, CASE WHEN r.id IS NOT NULL THEN 0.0 ELSE best.dist END AS dist FROM {of}items i LEFT JOIN {of}reps_all r ON r.id = i.id LEFT JOIN {of}best best ON best.id = i.id)"""


def greedy(select: str, order: str = "coalesce(n, 0) DESC, doc_id") -> str:
    return f"{_BASE}{_greedy('{} IS NOT NULL', order=order)}\n{select}"


def dbscan(select: str, near: str = "both_near", more: int = 1) -> str:
    """Density clusters of at least 3 points; more: 1 if a point counts among its own neighbours."""
    return base("").rstrip() + f""",
nearest AS MATERIALIZED (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS r FROM both_near),
both_knn AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM nearest WHERE r <= 5 UNION ALL SELECT b, a FROM nearest WHERE r <= 5)),
core AS MATERIALIZED (SELECT doc_id AS id, count(b) + {more} >= 3 AS is_core FROM documents LEFT JOIN {near} ON a = doc_id GROUP BY doc_id),
cores AS MATERIALIZED (SELECT a, b FROM {near} WHERE a IN (SELECT id FROM core WHERE is_core) AND b IN (SELECT id FROM core WHERE is_core)),
{_reach("reach_core", "cores")},
label AS MATERIALIZED (SELECT id, coalesce(c, id) AS cluster FROM core LEFT JOIN (SELECT a AS id, min(b) AS c FROM reach_core GROUP BY a) USING (id) WHERE is_core),
border AS (SELECT a AS id, min(cluster) AS cluster FROM {near} JOIN label ON label.id = b GROUP BY a),
placed AS (SELECT core.id, coalesce(label.cluster, border.cluster) AS cluster, is_core, coalesce(label.cluster, border.cluster) IS NULL AS is_noise FROM core LEFT JOIN label ON label.id = core.id LEFT JOIN border ON border.id = core.id)
{select}"""


DBSCAN_FILE = """SELECT -1::BIGINT AS cluster, '# DBSCAN clustering parameters: eps=0.100000, minPts=3' || chr(10) || '# Total clusters: ' || count(DISTINCT cluster) || chr(10) || '# Total noise points (outliers): ' || count(*) FILTER (is_noise) || chr(10) || '#' AS text FROM placed UNION ALL
SELECT n, 'the cluster ' || n || ' is: ' || chr(10) || t || chr(10) FROM (SELECT row_number() OVER (ORDER BY is_noise, cluster) - 1 AS n, t FROM (SELECT is_noise, cluster, string_agg(chr(9) || r || chr(9) || id || chr(9) || n_chars || 'nt' || chr(9) || coalesce(source, 'N/A') || chr(9) || coalesce(lang, 'N/A') || chr(9) || 'N/A', chr(10) ORDER BY id) AS t
FROM (SELECT id, is_noise, coalesce(cluster, id) AS cluster, n_chars, source, lang, row_number() OVER (PARTITION BY is_noise, coalesce(cluster, id) ORDER BY id) - 1 AS r FROM placed JOIN documents ON doc_id = id) GROUP BY is_noise, cluster))"""


def noise(select: str) -> str:
    """Noise and what is left without it, of clusters at a distance of 0.5."""
    return f"""{_BASE}{_FOREST},
both_wide AS MATERIALIZED (SELECT * FROM both_e WHERE dist <= 0.5),
{_reach("reach_wide", "both_wide")},
wide AS MATERIALIZED (SELECT doc_id AS id, coalesce(c, doc_id) AS cluster FROM documents LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach_wide GROUP BY a) USING (doc_id)),
dens AS (SELECT id, cluster, size, coalesce(d, 0) AS d FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM wide) LEFT JOIN (SELECT a AS id, count(*) AS d FROM both_e WHERE ceil(dist * 100 - 1e-9) <= 50 GROUP BY a) USING (id) WHERE size >= 2),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d, id) - 1 AS r FROM dens),
noise AS MATERIALIZED (SELECT p.id FROM placed p JOIN placed q ON p.cluster = q.cluster AND q.r = q.size // 4 WHERE p.d <= greatest(least(q.d - 1, 2), 0)),
clean AS MATERIALIZED (SELECT * FROM (SELECT i AS a, j AS b FROM msf WHERE dist <= 0.5 UNION ALL SELECT j, i FROM msf WHERE dist <= 0.5) WHERE a NOT IN (SELECT id FROM noise) AND b NOT IN (SELECT id FROM noise)),
{_reach("reach_clean", "clean")}
{select}"""


def repdb(select: str, queries: str = "benchmark") -> str:
    """A database and its answers q5 to queries: of all documents, or, for a batch of those whose id is divisible by 5, of the others."""
    asked = _sets("q", "benchmark", "item_id") if queries == "benchmark" else """
qw AS (SELECT * FROM w WHERE id % 5 = 0), qsk AS (SELECT * FROM sk WHERE id % 5 = 0), qsz AS (SELECT * FROM sz WHERE id % 5 = 0)"""
    return f"""{_BASE}{_greedy("{} IS NOT NULL" if queries == "benchmark" else "{} % 5 <> 0")},{asked},
rsk AS MATERIALIZED (SELECT sk.* FROM sk JOIN reps_all USING (id)),
qh AS (SELECT q, r, CASE WHEN jac >= 1 THEN 0.0 ELSE least(1.0, -ln(2 * jac / (1 + jac)) / 5) END AS d FROM (SELECT q, r, c::DOUBLE / (x.n + y.n - c) AS jac FROM (SELECT a.id AS q, b.id AS r, count(*) AS c FROM qsk a JOIN rsk b USING (hash) GROUP BY ALL) JOIN qsz x ON x.id = q JOIN sz y ON y.id = r)),
qr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rank FROM qh),
sizes AS MATERIALIZED (SELECT cluster, count(*) AS cluster_size FROM assigned GROUP BY cluster),
q5 AS MATERIALIZED (SELECT qw.id AS query, coalesce(rank, 0)::INT AS rank, r AS rep, round(d, 6) AS distance, r AS cluster, cluster_size FROM qw LEFT JOIN (SELECT * FROM qr WHERE rank <= 5) ON q = qw.id LEFT JOIN sizes ON sizes.cluster = r)
{select}"""


#: Batch items near an old representative open no cluster; all others do so in their order; each joins the nearest representative before it.
APPEND_GREEDY = _BASE + _greedy("{} % 5 <> 0") + """,
old_near AS MATERIALIZED (SELECT a AS id, b AS r, dist FROM both_near WHERE a % 5 = 0 AND b IN (SELECT id FROM reps_all))""" + _greedy("{} % 5 = 0 AND {} NOT IN (SELECT id FROM old_near)".replace("{}", "{0}"), "new_") + """,
turns AS MATERIALIZED (SELECT doc_id AS id, row_number() OVER (ORDER BY coalesce(n, 0) DESC, doc_id) AS place FROM documents LEFT JOIN sz ON sz.id = doc_id WHERE doc_id % 5 = 0),
met AS (SELECT id, r, dist, 0 AS age, r AS place FROM old_near UNION ALL SELECT a, b, dist, 1, q.place FROM both_near JOIN turns p ON p.id = a JOIN turns q ON q.id = b WHERE q.place < p.place AND b IN (SELECT id FROM new_reps_all))
SELECT id, cluster FROM assigned UNION ALL
SELECT t.id, CASE WHEN t.id IN (SELECT id FROM new_reps_all) THEN t.id ELSE m.r END AS cluster FROM turns t LEFT JOIN (SELECT id, first(r ORDER BY dist, age, place) AS r FROM met GROUP BY id) m USING (id)"""

REPDB_STATS = """SELECT clusters, members, min_size, max_size, mean_size, median_size, p90_size, p95_size, p99_size, singletons, min_sketch, max_sketch, mean_sketch, hashes, max_posting, avg_posting
FROM (SELECT count(*) AS clusters, sum(s)::BIGINT AS members, min(s) AS min_size, max(s) AS max_size, round(avg(s), 6) AS mean_size, max(s) FILTER (r = least(n - 1, floor(n * 0.5))) AS median_size, max(s) FILTER (r = least(n - 1, floor(n * 0.9))) AS p90_size, max(s) FILTER (r = least(n - 1, floor(n * 0.95))) AS p95_size, max(s) FILTER (r = least(n - 1, floor(n * 0.99))) AS p99_size, count(*) FILTER (s = 1) AS singletons FROM (SELECT cluster_size AS s, row_number() OVER (ORDER BY cluster_size, cluster) - 1 AS r, count(*) OVER () AS n FROM sizes)),
(SELECT min(n) AS min_sketch, max(n) AS max_sketch, round(avg(n), 6) AS mean_sketch FROM (SELECT reps_all.id, coalesce(sz.n, 0) AS n FROM reps_all LEFT JOIN sz USING (id))),
(SELECT count(*) AS hashes, max(c) AS max_posting, round(avg(c), 6) AS avg_posting FROM (SELECT hash, count(*) AS c FROM rsk GROUP BY hash))"""


def labels(select: str, label: str = "lang") -> str:
    return f"""{_BASE},
tab AS MATERIALIZED (SELECT cluster, {label} AS label, count(*) AS c FROM cl JOIN documents ON doc_id = id WHERE {label} IS NOT NULL GROUP BY ALL),
top AS MATERIALIZED (SELECT cluster, sum(c)::BIGINT AS total, first(label ORDER BY c DESC, label) AS dominant_label, max(c) AS dominant, count(*) AS n_labels FROM tab GROUP BY cluster)
{select}"""


NMI = """SELECT members::BIGINT AS members, round(mi, 6) AS mi, round(hc, 6) AS h_cluster, round(hl, 6) AS h_label, round(CASE WHEN hc + hl > 0 THEN 2 * mi / (hc + hl) ELSE 1 END, 6) AS nmi FROM
(SELECT max(n) AS members, sum(c / n * ln(c * n / (a * b))) AS mi FROM (SELECT c::DOUBLE AS c, sum(c) OVER ()::DOUBLE AS n, sum(c) OVER (PARTITION BY cluster)::DOUBLE AS a, sum(c) OVER (PARTITION BY label)::DOUBLE AS b FROM tab)),
(SELECT -sum(t / n * ln(t / n)) AS hc FROM (SELECT sum(c)::DOUBLE AS t, sum(sum(c)) OVER ()::DOUBLE AS n FROM tab GROUP BY cluster)),
(SELECT -sum(t / n * ln(t / n)) AS hl FROM (SELECT sum(c)::DOUBLE AS t, sum(sum(c)) OVER ()::DOUBLE AS n FROM tab GROUP BY label))"""

COOCCURRENCE = """SELECT label_a, label_b, n_clusters, members, CASE WHEN least(a, b) / members >= 0.3 AND m / members < 0.7 AND members >= 10 THEN 'boundary_conflict' WHEN greatest(a, b) / members >= 0.7 AND least(a, b) / members < 0.3 THEN 'minority_outlier' ELSE 'other' END AS kind
FROM (SELECT x.label AS label_a, y.label AS label_b, count(*) AS n_clusters, sum(total)::BIGINT AS members, sum(x.c) AS a, sum(y.c) AS b, sum(dominant) AS m FROM tab x JOIN tab y ON x.cluster = y.cluster AND x.label < y.label JOIN top ON top.cluster = x.cluster GROUP BY ALL)"""

PAIR_CLUSTERS = """SELECT cluster, total, count_a, count_b, round(count_a / (count_a + count_b), 6) AS ratio_a, count_a > 0 AND count_b > 0 AS is_mixed, CASE WHEN count_a = 0 OR count_b = 0 THEN 'single' WHEN least(count_a, count_b) / (count_a + count_b) >= 0.3 THEN 'balanced' ELSE 'minority' END AS balance
FROM (SELECT cluster, sum(c)::BIGINT AS total, coalesce(sum(c) FILTER (label = 'src0'), 0)::BIGINT AS count_a, coalesce(sum(c) FILTER (label = 'src1'), 0)::BIGINT AS count_b FROM tab GROUP BY cluster) WHERE count_a + count_b > 0"""

_BASES = f"translate(regexp_replace(lower(text), '[^a-z]', '_', 'g'), 'abcdefghijklmnopqrstuvwxyz_', '{'A' * 7 + 'C' * 6 + 'G' * 6 + 'T' * 7 + 'N'}')"
KMERS = f"""
WITH s AS (SELECT doc_id AS id, {_BASES} AS s FROM documents),
x AS (SELECT id, substr(s, p, 12) AS x FROM (SELECT id, s, unnest(range(1, length(s) - 10)) AS p FROM s WHERE length(s) >= 12)),
h AS (SELECT DISTINCT id, {_hash("least(x, reverse(translate(x, 'ACGT', 'TGCA')))")} AS hash FROM x WHERE x NOT LIKE '%N%')
SELECT s.id, count(hash) AS n, min(hash) AS first FROM s LEFT JOIN h USING (id) GROUP BY s.id"""

#: Of the canonical 16-mers' numbers the middle 24 bits are mixed; those below 2^20 stay, as the place under the outer bits.
DIMENSIONS = f"""
WITH s AS (SELECT doc_id AS id, {_BASES} AS s FROM documents),
x AS (SELECT id, substr(s, p, 16) AS x FROM (SELECT id, s, unnest(range(1, length(s) - 14)) AS p FROM s WHERE length(s) >= 16)),
u AS (SELECT id, list_sum(list_transform(range(1, 17), lambda i: (strpos('ACGT', y[i]) - 1) * (1::BIGINT << (2 * (16 - i)))))::BIGINT AS u FROM (SELECT DISTINCT id, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS y FROM x WHERE x NOT LIKE '%N%')),
m AS (SELECT id, u, (((u >> 4) & 16777215) * {0x9E3779B1 & 0xFFFFFF | 1}) & 16777215 AS d FROM u),
h AS (SELECT id, (((u >> 28) * 16 + (u & 15)) << 20) + p AS hash FROM (SELECT id, u, (xor(d, d >> 12) * {0x85EBCA77 & 0xFFFFFF | 1}) & 16777215 AS p FROM m) WHERE p < 1048576)
SELECT s.id, count(hash) AS n, min(hash) AS first, max(hash) AS last FROM s LEFT JOIN h USING (id) GROUP BY s.id"""

BOTTOM_BY_FILE = f"""WITH {_sets("", "conversations", "conv_id")}
SELECT id, count(*) AS n, min(hash) AS first, max(hash) AS last FROM sk GROUP BY id"""

BY_FILE = f"""WITH {_sets("", "conversations", "conv_id")}
SELECT c.conv_id AS id, count(hash) AS n, min(hash) AS first FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN full_set f ON f.id = c.conv_id GROUP BY c.conv_id"""

BASKETS = """
WITH s AS MATERIALIZED (SELECT DISTINCT o_custkey AS id, l_partkey AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT i, j, c, x.n AS a, y.n AS b FROM (SELECT q.id AS i, p.id AS j, count(*) AS c FROM s p JOIN s q ON p.h = q.h AND p.id < q.id GROUP BY ALL) JOIN z x ON x.id = i JOIN z y ON y.id = j)
"""

CLUSTER_FILE = base(r"""SELECT row_number() OVER (ORDER BY cluster) - 1 AS cluster, 'the cluster ' || (row_number() OVER (ORDER BY cluster) - 1) || ' is: ' || chr(10) || t || chr(10) AS text FROM (SELECT cluster, string_agg(chr(9) || r || chr(9) || id || chr(9) || n_chars || 'nt' || chr(9) || coalesce(source, 'N/A') || chr(9) || coalesce(lang, 'N/A') || chr(9) || 'N/A', chr(10) ORDER BY id) AS t FROM (SELECT cl.*, n_chars, source, lang, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS r FROM cl JOIN documents ON doc_id = id) GROUP BY cluster)""")
