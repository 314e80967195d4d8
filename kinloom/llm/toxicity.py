"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: on a sample of at most about SAMPLED labelled documents, chosen by a hash of the id, words
are counted by class in 2^HASH_BITS cells. A word's log-odds has a Dirichlet prior of PRIOR pseudo-counts
that its prefix shares out between the classes, so unseen words take their prefix's odds.

Scanning: in every whole text the linear-time scan of Ruzzo and Tompa finds all maximal segments of
log-odds less a drift. Karlin-Altschul theory, with lambda solved from clean tokens and K from the
best segments of clean documents, turns segment scores into expected numbers under chance; the best
sum statistic over the top segments goes through a logistic curve to a score from 0 to 1.

Part of the sample only calibrates (lambda, K, the curve) and isn't counted. Null and empty texts have
no token and get the curve's lowest score. A null doc_id is scored like any other. Rows that repeat
come back as often. With no labels of both classes every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import math
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.shared import bounded_batches, columns_checked, tidied

SAMPLED = 40_000
HASH_BITS = 18
PREFIX = 4
PRIOR = 16.0
DRIFT, LOW, HIGH = 0.5, -2.0, 6.0
#: Numbers of top segments that a sum statistic joins.
SUMS = (1, 2, 4, 8)
SIGNIFICANT = 0.05
REMEMBERED = 200_000
BIN = 0.1

_SPACED = bytes(32 if chr(b) in string.punctuation else b for b in range(256))
_MASK = (1 << HASH_BITS) - 1


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_SPACED).split()


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first, last), in linear time."""
    before = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, link
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(before[i]), float(before[i + 1]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, first, i, j))
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(r - a, f, t) for a, r, f, t, _ in found]


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray
    base: float
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    flat: float | None = None

    def token(self, word: bytes) -> float:
        cell, toward = zlib.crc32(word) & _MASK, self.share[zlib.crc32(word[:PREFIX]) & _MASK]
        odds = math.log((self.toxic[cell] + PRIOR * toward) / (self.clean[cell] + PRIOR * (1 - toward))) - self.base
        return min(HIGH, max(LOW, odds)) - DRIFT

    def scan(self, text: str | None, known: dict[bytes, float]) -> tuple[np.ndarray, list[tuple[float, int, int]]]:
        own = words(text)
        if self.flat is not None:  # nothing to tell the classes apart
            return np.zeros(len(own)), []
        for w in set(own).difference(known):
            known[w] = self.token(w)
        scores = np.array([known[w] for w in own])
        if len(known) > REMEMBERED:
            known.clear()
        return scores, segments(scores)

    def evidence(self, n: int, found: list[float]) -> tuple[float, float]:
        """The best sum statistic over the top segments, and the best segment's, both in nats."""
        if not found:
            return -math.log(max(n, 1) * self.scale + 1), -math.log(max(n, 1) * self.scale + 1)
        top = sorted(found, reverse=True)
        each = math.log(self.scale * max(n, 1) + 1e-9)
        sums = [self.rate * sum(top[:r]) - r * each + 2 * math.lgamma(r + 1) - math.log(r) for r in SUMS if r <= len(top)]
        return max(sums), sums[0]

    def score(self, n: int, found: list[float]) -> float:
        if self.flat is not None:
            return self.flat
        a, b, c = self.curve
        x, y = squeezed(self.evidence(n, found))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * x + c * y))))


def squeezed(evidence: tuple[float, float]) -> tuple[float, float]:
    return tuple(math.copysign(math.log1p(abs(v)), v) for v in evidence)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fitted(documents: DataFrame, labels: DataFrame, *, sampled: int = SAMPLED) -> Model:
    """Learn from labels(doc_id, toxic) of rows that aren't held out; the sample's bound is `sampled`."""
    spark = documents.sparkSession
    bounded_batches(spark)
    marked = columns_checked(labels, {"doc_id": "long", "toxic": "int"}).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = marked.count()
    part = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    sample = marked.where(part < int(min(1.0, sampled / max(rows, 1)) * (1 << 30))).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0)
    docs = columns_checked(documents, {"doc_id": "long", "text": "string"}).join(F.broadcast(sample), "doc_id").select("text", "toxic", "fold")

    def count(batches):
        seen, docs_seen = np.zeros((2, 2, 1 << HASH_BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for text, toxic, calibrates in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not calibrates:
                    own = set(words(text.as_py()))
                    seen[0, toxic] += np.bincount(np.fromiter((zlib.crc32(w) & _MASK for w in own), np.int64, len(own)), minlength=1 << HASH_BITS)
                    starts = {w[:PREFIX] for w in own}
                    seen[1, toxic] += np.bincount(np.fromiter((zlib.crc32(w) & _MASK for w in starts), np.int64, len(starts)), minlength=1 << HASH_BITS)
                    docs_seen[toxic] += 1
        for kind in (0, 1):
            at = np.flatnonzero(seen[kind].any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(seen[kind, 1, at]), pa.array(seen[kind, 0, at])], ["kind", "cell", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([2]), pa.array([0]), pa.array(docs_seen[1:]), pa.array(docs_seen[:1])], ["kind", "cell", "toxic", "clean"])

    counts = docs.mapInArrow(tidied(count), "kind long, cell long, toxic long, clean long").groupBy("kind", "cell").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    dense = np.zeros((3, 2, 1 << HASH_BITS), np.float32)
    dense[counts.kind, 0, counts.cell], dense[counts.kind, 1, counts.cell] = counts.toxic, counts.clean
    toxic_docs, clean_docs = dense[2, :, 0]
    if not toxic_docs or not clean_docs:
        return Model(*dense[0], dense[0, 0], 0.0, flat=float(toxic_docs > 0))
    share = toxic_docs / (toxic_docs + clean_docs)
    model = Model(*dense[0], (dense[1, 0] + PRIOR * share) / (dense[1].sum(0) + PRIOR), float(np.log(toxic_docs / clean_docs)))
    return _calibrated(model, docs.where("fold"))


def _calibrated(model: Model, docs: DataFrame) -> Model:
    def scan(batches):
        known: dict[bytes, float] = {}
        bins = int((HIGH - LOW) / BIN) + 2
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                scores, found = model.scan(text.as_py(), known)
                hist = np.bincount(np.rint((scores - LOW + DRIFT) / BIN).astype(int), minlength=bins).astype("<u4")
                out.append((toxic, len(scores), sorted((s for s, *_ in found), reverse=True)[: max(SUMS)], hist.tobytes()))
            c = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.float64())), pa.array(c[3], pa.binary())], ["toxic", "n", "top", "hist"])

    rows = docs.mapInArrow(tidied(scan), "toxic int, n long, top array<double>, hist binary").toPandas()
    clean, y = rows[rows.toxic == 0], rows.toxic.to_numpy(float)
    if not len(clean) or not y.any():
        model.flat = float(y.mean()) if len(y) else 0.0
        return model
    hist = sum((np.frombuffer(h, "<u4").astype(float) for h in clean["hist"]), np.zeros(1))
    value = np.arange(len(hist)) * BIN + LOW - DRIFT
    share = hist / max(hist.sum(), 1)
    low, high = 1e-3, 20.0  # lambda solves E[exp(lambda s)] = 1; the mean is below 0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * value)).sum() < 1 else (low, mid)
    model.rate = low
    best = np.array([model.rate * t[0] - math.log(n) for t, n in zip(clean["top"], clean["n"]) if len(t) and n])
    model.scale = float(np.clip(np.exp(best.mean() - np.euler_gamma), 1e-6, 1e3)) if len(best) else 1.0
    x = np.array([(1.0, *squeezed(model.evidence(n, list(t)))) for n, t in zip(rows["n"], rows["top"])])
    w = np.zeros(3)
    for _ in range(40):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w), -2, 2)
    model.curve = tuple(map(float, w))
    return model


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Score every row of documents(doc_id, text).

    Returns doc_id, score, predicted (score >= 0.5) and passages: each significant toxic passage as
    (first_word, last_word, score, expected), expected being the number of such segments that chance gives.
    """
    bounded_batches(documents.sparkSession)
    fields = "doc_id long, score double, predicted int, passages array<struct<first_word: int, last_word: int, score: double, expected: double>>"
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        known: dict[bytes, float] = {}
        for b in batches:
            scores, passages = [], []
            for text in b.column(1):
                tokens, found = model.scan(text.as_py(), known)
                n = len(tokens)
                scores.append(model.score(n, [s for s, *_ in found]))
                odd = [(f, t, s, model.scale * n * math.exp(-model.rate * s)) for s, f, t in found]
                passages.append([dict(zip(("first_word", "last_word", "score", "expected"), o)) for o in odd if o[3] <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], ["doc_id", "score", "predicted", "passages"])

    return columns_checked(documents, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run), fields)


def accepted(documents: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """The rows of documents that the model doesn't reject, with all their columns; one pass, no join."""
    bounded_batches(documents.sparkSession)

    def run(batches):
        known: dict[bytes, float] = {}
        for b in batches:
            keep = []
            for text in b.column(b.schema.get_field_index(column)):
                tokens, found = model.scan(text.as_py(), known)
                keep.append(model.score(len(tokens), [s for s, *_ in found]) < 0.5)
            yield b.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(tidied(run), documents.schema)
