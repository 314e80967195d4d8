"""URL verdicts: listed rules first, then logistic regression on hashed character n-grams of host and path.

The classifier is trained on a small labelled URL table, LABELLED by default, which the driver reads whole
(at most LABELLED_BOUND rows). Its weights are whole millionths, so sums are exact in any order. Judging uses
DataFrame functions only and shuffles nothing.

A null url, or one without ://, has an empty host and path and is judged by the classifier on these.
Repeated rows come back as often; an empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.kmers import bound

CELLS = 2048
SIZES = (3, 4)
FACTORS = (1009, 9176, 51749, 350377)
SCALE = 1_000_000
LABELLED_BOUND = 100_000
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What the labelled table's urls are made of: topics to block, topics to allow, and what both kinds have in common.
_BLOCK = "casino poker betting slots jackpot porn sexcam escort adult nude viagra cialis pills steroid warez crack keygen torrent nulled payday loanshark replica counterfeit spam malware phishing popup adserver clickbait doorway".split()
_ALLOW = "wiki docs library news science museum research journal school history manual tutorial recipes travel garden weather music poetry archive lecture physics geology theatre cooking cycling maths grammar economy railway astronomy".split()
_BOTH = "shop blog forum home about contact page item index search user list view gallery static today world city online store".split()
_ENDS = {1: "com net biz top xyz info ru click win".split(), 0: "com net org edu info io de fr gov".split()}
_LETTERS = str.maketrans("oiea", "013@")
HELD_OUT = 5


@lru_cache(1)
def every_labelled(rows: int = 1000) -> tuple[tuple[str, int], ...]:
    """A small labelled URL table: (url, 1 to block or 0 to allow), hosts and paths put together at random from a fixed seed."""
    draw, out = random.Random(20240501), []
    for _ in range(rows):
        y = draw.randrange(2)
        topic, other = draw.choice(_BLOCK if y else _ALLOW), draw.choice(_BOTH)
        if y and draw.random() < 0.15:
            topic = topic.translate(_LETTERS)
        about = draw.choice((topic, topic + other, other + topic, f"{topic}-{draw.randrange(1000)}", f"{other}-{topic}"))
        plain = draw.choice((other, draw.choice(_BOTH) + other, f"{other}{draw.randrange(100)}"))
        end = draw.choice(_ENDS[y])
        first = draw.choice(("", "www.", "m.", draw.choice(_BOTH) + "."))
        steps = [draw.choice((draw.choice(_BOTH), str(draw.randrange(10_000)), topic, "en", "de", "fr")) for _ in range(draw.randrange(4))]
        host = about if draw.random() < 0.7 else plain
        if host == plain:
            steps.insert(draw.randrange(len(steps) + 1), about)
        tail = draw.choice(("", "/", ".html", "?page=2", "#top", ".php?id=7"))
        out.append((f"{draw.choice(('http', 'https'))}://{first}{host}.{end}/{'/'.join(steps)}{tail}", y))
    return tuple(out)


def labelled() -> tuple[tuple[str, int], ...]:
    """The rows that the classifier learns from."""
    return tuple(r for i, r in enumerate(every_labelled()) if i % HELD_OUT)


def accuracy() -> float:
    """Share of right verdicts on the rows that weren't learned from."""
    base, weights = trained()
    rest = [r for i, r in enumerate(every_labelled()) if i % HELD_OUT == 0]
    return sum((base + sum(weights[c] for c in cells_of(u)) > 0) == bool(y) for u, y in rest) / len(rest)


def parts_of(url: str | None) -> tuple[str, str]:
    """Host and path by the same rules as parts(), for the training table."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), path[:end]


def cells_of(url: str | None) -> list[int]:
    """The cells of a URL's n-grams, host and path apart."""
    out = []
    for side, s in enumerate(parts_of(url)):
        codes = [94, *map(ord, s), 36]
        for n in SIZES:
            out += [(sum(c * f for c, f in zip(codes[i : i + n], FACTORS)) + 31 * side + 7 * n) % CELLS for i in range(len(codes) - n + 1)]
    return out


@lru_cache(4)
def trained(table: tuple[tuple[str, int], ...] | None = None) -> tuple[int, tuple[int, ...]]:
    """Intercept and cell weights in millionths, by penalised gradient descent on the labelled table."""
    table = labelled() if table is None else table
    if len(table) > LABELLED_BOUND:
        raise ValueError(f"the labelled table has more than {LABELLED_BOUND} rows")
    x = np.zeros((len(table), CELLS))
    for row, (url, _) in zip(x, table):
        np.add.at(row, cells_of(url), 1)
    y, w, b = np.array([t[1] for t in table], float), np.zeros(CELLS), 0.0
    if not len(y) or y.min() == y.max():
        return (SCALE if len(y) and y[0] else -SCALE), (0,) * CELLS
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        w -= 0.05 * (x.T @ (p - y) / len(y) * 4 + 1e-3 * w)
        b -= 0.05 * float((p - y).mean()) * 4
    return round(b * SCALE), tuple(int(v) for v in np.rint(w * SCALE))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z lower-cased, and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _weights_of(codes: Column, n: int, salt: int, table: Column) -> Column:
    """Sum of the weights of all n-grams of an array of code points."""

    none = F.lit(0).cast("bigint")

    def added(codes: Column) -> Column:
        def add(total, i):
            cell = F.pmod(sum((F.get(codes, i + k) * FACTORS[k] for k in range(1, n)), F.get(codes, i) * FACTORS[0]) + F.lit(salt), F.lit(CELLS))
            return total + F.get(table, cell.cast("int"))

        return F.when(F.size(codes) >= n, F.aggregate(F.sequence(F.lit(0), F.size(codes) - n), none, add)).otherwise(none)

    return bound(codes, added)


def margin(host: Column, path: Column, model: tuple[int, tuple[int, ...]]) -> Column:
    """The classifier's margin in millionths; above 0 is block."""
    base, weights = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    total = F.lit(base).cast("bigint")
    for side, s in enumerate((host, path)):
        codes = F.transform(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), lambda c: F.ascii(c).cast("bigint"))
        for n in SIZES:
            total = total + _weights_of(codes, n, 31 * side + 7 * n, table)
    return total


def judged(df: DataFrame, *, rules=RULES, model: tuple[int, tuple[int, ...]] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdicts on df's urls: (key, host, path, rule, verdict), by the longest rule that fits, else by the classifier."""
    model = trained() if model is None else model
    host, path = parts(F.col(f"`{url}`").cast("string"))
    rows = df.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.when(margin(F.col("host"), F.col("path"), model) > 0, "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rows.select(key, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def oracle() -> str:
    """judged() over the pages view, in DuckDB SQL."""
    base, weights = trained()
    total = str(base)
    for side, s in enumerate(("host", "path")):
        codes = f"{s}_codes"
        for n in SIZES:
            cell = " + ".join(f"{codes}[i + {k + 1}] * {FACTORS[k]}" for k in range(n))
            total += f" + coalesce(list_sum(list_transform(range(0, len({codes}) - {n - 1}), lambda i: w.v[((({cell}) + {31 * side + 7 * n}) % {CELLS}) + 1])), 0)"
    rule, verdict = "NULL", f"CASE WHEN {total} > 0 THEN 'block' ELSE 'allow' END"
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    codes = lambda s: f"list_transform(string_split('^' || {s} || '$', ''), lambda c: ascii(c)::BIGINT) AS {s}_codes"
    return f"""
WITH w AS (SELECT {list(weights)} AS v),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT page_id, host, path, {codes("host")}, {codes("path")} FROM h)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM c, w"""
