"""Packing along a space-filling curve.

Each document becomes a hashed vector of its byte 4-grams, projected to three dimensions by random
signs; the cell of the projection on a Hilbert curve is its key. Documents are range-split by
(key, a hash of the id), so that even one key with a third of all rows spreads over many ranges, and
each range is sorted by key and filled into sequences in that order: neighbours on the curve share a
sequence. Documents are cut where a sequence is full, so only a range's last sequence has padding.

The range borders come from a sample of at most SAMPLED rows; they set the balance of the tasks, while
every row is placed and packed. Null and empty texts consist of the closing id alone. Rows that repeat
are packed as often as they occur; a null doc_id stays null. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinloom.llm.shared import bounded_batches, columns_checked, tidied

DIMENSIONS, BITS = 3, 10
SAMPLED = 20_000
RANGE_BYTES = 8 << 20
#: Bytes of text whose keys are made at once.
BYTES_AT_ONCE = 1 << 20
SEQUENCE = 2048
#: Bits of a dimension's count in the shared number; longer texts are counted apart.
FIELD = 21
#: Largest mean sign, in either direction, over which the curve's cells are laid; what lies beyond falls in the outer cells.
SPREAD = 0.15


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells (n, d), by the transposed Gray-code form."""
    x = cells.astype(np.int64).T.copy()
    d, high = len(x), 1 << (bits - 1)
    q = high
    while q > 1:
        p = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = high
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 borders; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert keys of texts, some BYTES_AT_ONCE at a time."""
    ends, at, parts = text_bytes(column)[1][1:], 0, [np.zeros(0, np.int64)]
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        parts.append(_curve_keys(column.slice(at, end - at)))
        at = end
    return np.concatenate(parts)


def _curve_keys(column: pa.Array) -> np.ndarray:
    data, borders = text_bytes(column)
    grams = np.zeros(len(data) + 4, "<u4")
    padded = np.concatenate([data, np.zeros(12, np.uint8)]).tobytes()
    for k in range(4):
        own = grams[k::4]
        own[:] = np.frombuffer(padded, "<u4", len(own), k)
    grams *= np.uint32(0x9E3779B1)
    # the product's top bits are the signs of the three dimensions; their counts share one number
    grams >>= np.uint32(32 - DIMENSIONS)
    fields = np.array([sum((v >> k & 1) << (FIELD * k) for k in range(DIMENSIONS)) for v in range(1 << DIMENSIONS)], np.uint64)
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(fields[grams], out=total[1:])
    # 4-grams that cross into the next text are left out
    lengths = np.maximum(np.diff(borders) - 3, 0)
    sums = total[borders[:-1] + lengths] - total[borders[:-1]]
    ones = np.stack([(sums >> np.uint64(FIELD * k)) & np.uint64((1 << FIELD) - 1) for k in range(DIMENSIONS)], 1).astype(np.int64)
    for i in np.flatnonzero(lengths >= 1 << FIELD):
        own = grams[borders[i] : borders[i] + lengths[i]]
        ones[i] = [int((own >> np.uint32(k) & np.uint32(1)).sum(dtype=np.int64)) for k in range(DIMENSIONS)]
    mean = (2 * ones - lengths[:, None]) / np.maximum(lengths, 1)[:, None]
    cells = np.clip((mean / SPREAD + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_index(cells.astype(np.int64))


class ByteBpe:
    """The ids of a byte-level vocabulary file of the tokenizers library.

    The merges run in tiktoken on the same vocabulary, which gives the same ids; a text that its
    matcher refuses goes to the library itself.
    """

    def __init__(self, file: str, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = Tokenizer.from_file(file)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.special, self.fast = set(special), tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        try:
            if "<|" in text:
                return self.fast.encode(text, allowed_special=self.special, disallowed_special=())
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its matcher panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.library.encode(text, add_special_tokens=False).ids


_LOADED: dict[tuple, ByteBpe] = {}


def loaded(files: tuple[str, str, str]) -> ByteBpe:
    if files not in _LOADED:
        _LOADED[files] = ByteBpe(*files)
    return _LOADED[files]


def range_borders(docs: DataFrame, rows: int, ranges: int) -> list[tuple[int, int]]:
    """Borders of the ranges of (key, tie), from a sample of about SAMPLED rows."""
    if ranges < 2:
        return []
    limit = int(min(1.0, SAMPLED / max(rows, 1)) * (1 << 30))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < limit)

    def run(batches):
        for b in batches:
            size = np.diff(text_bytes(b.column(1))[1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(b.column(1)), pa.int64()), b.column(2), pa.array(size, pa.int64())], ["key", "tie", "size"])

    found = sample.mapInArrow(tidied(run), "key long, tie long, size long").orderBy("key", "tie").collect()
    size = np.cumsum([r.size for r in found]) if found else np.zeros(1)
    at = np.searchsorted(size, np.linspace(0, size[-1], ranges + 1)[1:-1])
    return [(r.key, r.tie) for r in (found[min(i, len(found) - 1)] for i in at)] if found else []


def packed(df: DataFrame, files: tuple[str, str, str], *, closing: int = 1, sequence: int = SEQUENCE, range_bytes: int = RANGE_BYTES, keep_ids: bool = False) -> DataFrame:
    """Pack df(doc_id, text) into sequences of at most `sequence` ids.

    files: the vocabulary as the tokenizers library reads it, its ranks file, its splitting pattern.
    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, and
    ids (little-endian unsigned 32-bit) with keep_ids. sequence_id is unique; offsets have no gap.
    One shuffle moves each text once; ids are made where they are packed and never stored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = columns_checked(df, {"doc_id": "long", "text": "string"}).withColumn("tie", F.xxhash64("doc_id"))
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    ranges = max(1, round(total.b / range_bytes))
    placed = _placed(docs, range_borders(docs, total.n, ranges))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long" + (", ids binary" if keep_ids else "")

    def pack(batches):
        now, seq, fill = None, 0, 0
        bpe = loaded(files)
        for b in batches:
            out = []
            for part, key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if part != now:
                    now, seq, fill = part, 0, 0
                ids = np.array([*bpe.encode(text.as_py() or ""), closing], "<u4")
                n, at = len(ids), 0
                while at < n:
                    if fill == sequence:
                        seq, fill = seq + 1, 0
                    size = min(n - at, sequence - fill)
                    raw = ids[at : at + size].tobytes()
                    out.append((doc, at, size, zlib.crc32(raw), n, (part << 32) + seq, fill, key, *([raw] if keep_ids else [])))
                    at, fill = at + size, fill + size
            columns = list(zip(*out)) if out else [()] * (8 + keep_ids)
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:8]), *([pa.array(columns[8], pa.binary())] if keep_ids else [])], names)

    spread = placed.repartition(max(ranges, 1), "part").sortWithinPartitions("part", "key", "tie", "doc_id")
    return spread.select("part", "key", "doc_id", "text").mapInArrow(tidied(pack), fields)


def _placed(docs: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
    """With the key and the number of the range of each row: how many borders lie at or below (key, tie)."""
    keys, ties = (np.array([b[i] for b in borders], np.int64) for i in (0, 1))

    def run(batches):
        for b in batches:
            key, tie = curve_keys(b.column(1)), np.asarray(b.column(2), np.int64)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            part = low.astype(np.int64)
            for i in np.flatnonzero(high > low):
                part[i] += np.searchsorted(ties[low[i] : high[i]], tie[i], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.int64()), pa.array(part, pa.int64())], ["doc_id", "text", "tie", "key", "part"])

    return docs.mapInArrow(tidied(run), "doc_id long, text string, tie long, key long, part long")
