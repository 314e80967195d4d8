"""Near-duplicate documents: MinHash over word shingles, exact links, components.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its
distinct shingles of `width` words, one shingle of all words if there are fewer, none without words. Two
documents are linked if den * intersection >= num * union; empty sets link with nothing.

Equal sets are one class, told by 128 bits, and only classes are compared. A row without an id keeps its
place and links with nothing (component null, kept). Links are found between texts: the texts of a repeated
id are nodes of their own, told by 64 bits of id and text, and meet only in the reported component, which has
the links of all of them. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import linking
from kinloom.llm.linking import Setting, mixed
from kinloom.llm.shared import Workspace, bounded_batches, columns_checked, components, tidied, touched

WORDS_REMEMBERED = 200_000
_KNOWN: dict[bytes, int] = {}
_STEP = np.uint64(0xA24BAED4963EE407)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > WORDS_REMEMBERED:
        _KNOWN.clear()
    for w in set(own).difference(_KNOWN):
        _KNOWN[w] = xxhash.xxh64_intdigest(w)
    h = np.array([_KNOWN[w] for w in own], np.uint64)
    width = min(width, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = mixed(out * _STEP + h[k : k + len(out)])
    return np.unique(out)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    return linking.coded([shingles(t, width) for t in texts])


def sketched(df: DataFrame, width: int, setting: Setting) -> DataFrame:
    """Per row of df(id, text, doc): doc, n, the class key (k1, k2), band keys, pivots, crowds and signature."""

    def run(batches):
        a, b = setting.coefficients()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingles(t.as_py(), width) for t in batch.column(1)]
            n = np.array([len(x) for x in sets], np.int64)
            k1 = np.array([int(mixed(x).sum(dtype=np.uint64)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            k2 = np.array([int(mixed(x ^ _STEP).sum(dtype=np.uint64)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            seen, own = set(), []  # a set that repeats in the batch sends its bands once
            for i, c in enumerate(zip(k1.tolist(), k2.tolist(), n.tolist())):
                if ids[i] is not None and c[2] and c not in seen:
                    seen.add(c)
                    own.append(i)
            at = np.array(own, np.int64)
            mins = np.stack([linking.minima((sets[i] >> np.uint64(32)).astype(np.uint32), a, b) for i in own]) if own else np.zeros((0, setting.permutations), np.uint32)
            parts = linking.combined(linking.band_keys(mins, setting), np.array([ids[i] for i in own], np.int64))
            # rows without a set of their own have empty lists
            place = np.full(len(ids), len(own))
            place[at] = np.arange(len(own))
            parts = [pa.concat_arrays([p, pa.array([b"" if pa.types.is_binary(p.type) else []], p.type)]).take(pa.array(place)) for p in parts]
            sig = [None] * len(ids)
            for i, x in zip(own, linking.signature(mins)):
                sig[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(k1), pa.array(k2), *parts, pa.array(sig, pa.binary()), batch.column(2)],
                ["id", "n", "k1", "k2", "keys", "pivots", "crowds", "sig", "doc"],
            )
        _KNOWN.clear()  # other stages run in the same worker

    return df.mapInArrow(tidied(run), "id long, n long, k1 long, k2 long, keys binary, pivots array<long>, crowds array<long>, sig binary, doc long")


def row_key(doc, text):
    """64 bits of an id and a text, null without an id."""
    return F.when(doc.isNotNull(), F.xxhash64(doc.cast("long"), F.coalesce(text.cast("string"), F.lit(""))))


def near_duplicates(df: DataFrame, *, width: int = 5, setting: Setting = Setting()) -> DataFrame:
    """Classes of near-duplicates of df(doc_id, text).

    Returns per row doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept
    (doc_id is its component's id), row_key and first (the row's text is the one of its linked texts that
    firsts keeps: that of the smallest doc_id; texts without words always are).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "neardup")
    docs = columns_checked(df, {"doc_id": "long", "text": "string"}).select(row_key(F.col("doc_id"), F.col("text")).alias("id"), "text", F.col("doc_id").alias("doc"))
    table = ws.store(sketched(docs, width, setting))
    known = table.where("id is not null and n > 0")
    least = known.groupBy("k1", "k2", "n").agg(F.min("id").alias("least"))
    copies = known.select("id", "k1", "k2", "n").join(least, ["k1", "k2", "n"]).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    firsts = known.where("sig is not null")
    signatures = firsts.select("id", "n", "sig")
    texts = docs.where("id is not null").select("id", "text")
    edges = linking.linked(ws, linking.candidates(ws, firsts), signatures, texts, partial(shingle_sets, width=width), setting, copies)
    part = components(ws, edges)
    ws.drop(edges)
    placed = ws.store(table.select("id", "doc", "n").join(part, "id", "left").withColumn("of", F.coalesce("component", "id")).drop("component"))
    ws.drop(table, part)
    lead = placed.where("id is not null").groupBy("of").agg(F.min(F.struct("doc", "id")).alias("lead"))
    rows = ws.store(placed.join(lead, "of", "left").select("id", "doc", "n", "of", F.col("lead.doc").alias("lead"), F.coalesce(F.col("id") == F.col("lead.id"), F.lit(True)).alias("first")))
    ws.drop(placed)
    several = ws.store(rows.where("id is not null").groupBy("doc").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("doc"))
    component = F.col("lead")
    if not several.isEmpty():
        joined = components(ws, rows.join(several, "doc", "left_semi").select(F.col("doc").alias("u"), F.col("lead").alias("v")))
        rows = rows.join(joined.select(F.col("id").alias("lead"), "component"), "lead", "left")
        component = F.coalesce("component", "lead")
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"), F.col("id").alias("row_key"), "first")


def firsts(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df with one row of each class of linked texts, that of the smallest id; rows without an id or without words stay.

    classes: near_duplicates(df). Of rows that repeat an id only those go whose text is linked with a kept one, or equal.
    """
    key = "__neardup_key"
    known = classes.where("row_key is not null")
    rows = df.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    # null: stays; True: one of equal rows stays; False: goes
    marks = known.groupBy(F.col("row_key").alias(key)).agg(F.bool_and("first").alias("__first"), F.count("*").alias("c")).where("c > 1 or not __first").drop("c")
    some, others = touched(rows, marks, key)
    judged = some.join(marks, key, "left")
    one = judged.where("__first").dropDuplicates([key])
    return others.unionByName(judged.where("__first is null").unionByName(one).drop("__first")).select(*[f"`{c}`" for c in df.columns])
