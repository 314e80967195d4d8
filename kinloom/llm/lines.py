"""Fuzzy line deduplication: MinHash over character shingles, exact Jaccard, components, one line kept.

A line is what stands between line feeds, lower-cased and with runs of white space made one space. Blank
lines are never touched. A line's set holds its distinct shingles of SHINGLE characters, the whole line as
one if it is shorter. Lines are linked if their sets' Jaccard similarity reaches the setting's threshold;
of each component the line with the smallest (doc_id, row_key, place) stays and all others go.

Equal lines are told by 64 bits of their hash. A shared band with a probability of 0.9994 at the threshold
itself makes two lines candidates; above it the probability rises fast. Rows without an id or a text lose
nothing and make no other line a duplicate. Rows that repeat an id are told apart by their texts; rows
equal in both are one and share its decisions. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import linking
from kinloom.llm.linking import Setting, mixed
from kinloom.llm.neardup import row_key
from kinloom.llm.shared import Workspace, bounded_batches, columns_checked, components, tidied, touched

SHINGLE = 7
LINES = Setting(num=80, den=100, bands=14, width=4)
LETTERS = 1 << 19
#: Shingles that are hashed at once.
_TILE = 1 << 16
_P = 0x2545F491


def normal(line: str) -> str:
    line = line.lower()
    # all white space but the space itself is unprintable
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        return line
    return " ".join(line.split())


def line_id(line: str) -> int:
    """64 bits of a normal line's hash, as a signed number."""
    h = xxhash.xxh3_64_intdigest(line.encode())
    return h - (1 << 64) if h >> 63 else h


def shingles(line: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a normal line's character shingles."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    width = min(SHINGLE, len(c))
    out = np.zeros(len(c) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3 * 0x9E37 + 2 * k + 1) + c[k : k + len(out)]
    return np.unique(mixed(out))


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """The sets of many normal lines, in the form of linking.coded()."""
    parts = [_shingle_sets(lines[k : k + linking.AT_ONCE]) for k in range(0, max(len(lines), 1), linking.AT_ONCE)]
    if len(parts) == 1:
        return parts[0]
    ends = np.cumsum([0] + [len(codes) for codes, _, _ in parts])
    borders = np.concatenate([[0]] + [own[1:] + end for (_, own, _), end in zip(parts, ends)])
    return np.concatenate([codes for codes, _, _ in parts]), borders, parts[0][2]


def _shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    size = np.array([len(x) for x in lines], np.int64)
    c = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    rolled = np.zeros(max(len(c) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled *= np.uint64(0x100000001B3 * 0x9E37 + 2 * k + 1)
        rolled += c[k : k + len(rolled)]
    n = np.maximum(size - SHINGLE + 1, 0)
    inside = np.arange(n.sum()) + np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n)
    short = [(i, shingles(lines[i])) for i in np.flatnonzero(size < SHINGLE)]
    hashes = np.concatenate([mixed(rolled[inside]), *(x for _, x in short)])
    owner = np.concatenate([np.repeat(np.arange(len(lines)), n), *(np.full(len(x), i) for i, x in short)])
    many = 1 << linking.CODE_BITS
    key = np.sort(owner * many + (hashes >> np.uint64(64 - linking.CODE_BITS)).astype(np.int64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key % many, np.searchsorted(key, np.arange(len(lines) + 1) * many), many


def batch_minima(lines: list[str], setting: Setting) -> np.ndarray:
    """(lines, permutations) minima of many normal lines, some LETTERS at a time."""
    ends = np.cumsum([len(x) for x in lines])
    parts, at = [np.zeros((0, setting.permutations), np.uint32)], 0
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")))
        parts.append(_batch_minima(lines[at:end], setting))
        at = end
    return np.concatenate(parts)


def _batch_minima(lines: list[str], setting: Setting) -> np.ndarray:
    a, b = setting.coefficients()
    size = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le") + bytes(4 * SHINGLE), "<u4")
    rolled = np.zeros(len(codes) - SHINGLE + 1, np.uint32)
    for k in range(SHINGLE):
        rolled *= np.uint32(_P)
        rolled += codes[k : k + len(rolled)]
    rolled ^= rolled >> np.uint32(16)
    rolled *= np.uint32(0x7FEB352D)
    rolled ^= rolled >> np.uint32(15)
    # the shingles of all lines one after another, without those that reach over a line's end
    n = np.maximum(size - SHINGLE + 1, 1)
    ends = np.cumsum(n)
    starts = ends - n
    x = rolled[np.arange(ends[-1]) + np.repeat(np.cumsum(size) - size - starts, n)]
    short = np.flatnonzero(size < SHINGLE)
    x[starts[short]] = np.array([line_id(lines[i]) & 0xFFFFFFFF for i in short], np.uint32)
    out = np.full((setting.permutations, len(lines)), 0xFFFFFFFF, np.uint32)
    room = np.empty(min(_TILE, len(x)), np.uint32)
    for k in range(0, len(x), _TILE):
        tile = x[k : k + _TILE]
        h = room[: len(tile)]
        first, last = np.searchsorted(ends, [k, k + len(tile) - 1], "right")
        own, at = out[:, first : last + 1], np.maximum(starts[first : last + 1] - k, 0)
        for p in range(setting.permutations):
            np.multiply(tile, a[p], out=h)
            h += b[p]
            np.minimum(own[p], np.minimum.reduceat(h, at), out=own[p])
    return out.T


def sketched(docs: DataFrame, setting: Setting) -> DataFrame:
    """Each distinct line of a batch of docs(row, doc, text): id, signature, band keys, pivots, crowds, text, and where it stands (docs, rows, places)."""

    def run(batches):
        for batch in batches:
            where: dict[str, tuple[list, list, list]] = {}
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if row is not None and text.is_valid:
                    for k, x in enumerate(text.as_py().split("\n")):
                        if x := normal(x):
                            at = where.setdefault(x, ([], [], []))
                            at[0].append(doc)
                            at[1].append(row)
                            at[2].append(k)
            own = [*where]
            ids = np.array([line_id(x) for x in own], np.int64)
            mins = batch_minima(own, setting) if own else np.zeros((0, setting.permutations), np.uint32)
            parts = linking.combined(linking.band_keys(mins, setting), ids)
            sig = [x.tobytes() for x in linking.signature(mins)]
            at = [x if len(x[0]) == 1 else tuple(zip(*sorted(zip(*x)))) for x in map(where.get, own)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in at], dtype=np.int64)]).astype(np.int32))
            spots = [pa.ListArray.from_arrays(offsets, pa.array([y for x in at for y in x[c]], kind)) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sig, pa.binary()), *parts, pa.array(own, pa.string()), *spots], ["id", "sig", "keys", "pivots", "crowds", "text", "docs", "rows", "places"])

    schema = "id long, sig binary, keys binary, pivots array<long>, crowds array<long>, text string, docs array<long>, rows array<long>, places array<int>"
    return docs.mapInArrow(tidied(run), schema)


def duplicate_lines(df: DataFrame, *, setting: Setting = LINES) -> DataFrame:
    """(doc_id, row_key, removed): the places, from 0, of the lines of df(doc_id, text) that go; only rows that lose any.

    row_key is neardup.row_key() of the id and the text: rows that repeat an id with other texts have their own.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "lines")
    docs = columns_checked(df, {"doc_id": "long", "text": "string"}).select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("doc_id").alias("doc"), "text")
    table = ws.store(sketched(docs, setting))
    edges = linking.linked(ws, linking.candidates(ws, table), table.select("id", "sig", "text"), None, shingle_sets, setting)
    part = components(ws, edges)
    ws.drop(edges)
    # only lines that stand at several places, or have near ones, can go
    often = table.groupBy("id").agg(F.sum(F.size("rows")).alias("c")).where("c > 1").select("id")
    several = ws.store(often.join(part, "id", "full").select("id", F.coalesce("component", "id").alias("line")))
    placed = ws.store(touched(table.select("id", "docs", "rows", "places"), several, "id")[0].join(several, "id").select("line", "docs", "rows", "places"))
    ws.drop(table, part, several)
    # each row's places are sorted
    at = F.struct(F.col("docs")[0].alias("doc"), F.col("rows")[0].alias("row"), F.col("places")[0].alias("place"))
    first = ws.store(placed.groupBy("line").agg(F.min(at).alias("first")))  # stored, so that the join can split a very common line
    each = placed.join(first, "line").select("first", F.explode(F.arrays_zip("docs", "rows", "places")).alias("x"))
    gone = each.select("first", F.struct(F.col("x.docs").alias("doc"), F.col("x.rows").alias("row"), F.col("x.places").alias("place")).alias("at")).where("at <> first").select("at.*")
    removed = ws.store(gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("place")).alias("removed")))
    ws.drop(placed, first)
    return removed.select(F.col("doc").alias("doc_id"), F.col("row").alias("row_key"), "removed")


def without_lines(df: DataFrame, removed: DataFrame, column: str = "text") -> DataFrame:
    """df(doc_id, column, ...) without the lines at removed(row_key, removed); rows that lose every line go, all other columns stay."""
    names, key, gone = df.columns, "__lines_row", "__lines_gone"

    def cut(text, places):
        drop = set(places)
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            places = b.column(b.num_columns - 1).to_pylist()
            new = [t if g is None else cut(t, g) for t, g in zip(b.column(at).to_pylist(), places)]
            whole = pa.array([g is None or bool(t.strip()) for t, g in zip(new, places)], pa.bool_())
            columns = [pa.array(new, b.schema.field(at).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([c.filter(whole) for c in columns], names)

    rows = df.withColumn(key, row_key(F.col("doc_id"), F.col(f"`{column}`")))
    places = removed.select(F.col("row_key").alias(key), F.col("removed").alias(gone))
    some, others = touched(rows, places, key)
    both = some.join(places, key, "left").select(*[f"`{c}`" for c in names], gone)
    return others.select(*[f"`{c}`" for c in names]).unionByName(both.mapInArrow(tidied(run), df.schema))
