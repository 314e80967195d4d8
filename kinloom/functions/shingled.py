"""Hashes of word shingles by the batch: md5 of many short slices of one buffer at once.

The hashes are those of kmers.hash60 and the words those of kmers.word_shingles; texts come lower-cased.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SPACES = bytes(32 if c in b" \t\n\x0b\f\r" else c for c in range(256))

#: Slices hashed at once, so that their states stay in a core's cache; blocks of 64 bytes beyond which a slice is hashed alone.
TILE, BLOCKS = 4096, 4
#: Bytes of text that a task cuts at once.
HELD = 1 << 21


def _compressed(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The md5 states after one more block each; words: (16, n) of uint32."""
    a, b, c, d = (x.copy() for x in state)
    f, r = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        a += np.uint32(_SINES[i])
        a += words[g]
        s = _SHIFTS[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=r)
        a >>= np.uint32(32 - s)
        a |= r
        a += b
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def hashes60(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 60 bits of the md5 of data[start[k]:end[k]] for each k; data: bytes."""
    out, size = np.empty(len(start), np.int64), end - start
    blocks = (size + 8) // 64 + 1
    padded = np.concatenate([data, np.zeros(64 * BLOCKS, np.uint8)])
    for n in range(1, BLOCKS + 1):
        these, wide = np.flatnonzero(blocks == n), 64 * n
        rows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, wide), (1, 1))
        keep = np.tri(wide + 1, wide, -1, np.uint8)
        for at in range(0, len(these), TILE):
            k = these[at : at + TILE]
            own = rows[start[k]] * keep[size[k]]
            own[np.arange(len(k)), size[k]] = 0x80
            words = np.ascontiguousarray(own.view("<u4").T)
            words[16 * n - 2] = size[k] * 8
            state = [np.full(len(k), x, np.uint32) for x in _START]
            for b in range(n):
                state = _compressed(state, words[16 * b : 16 * b + 16])
            high, low = state[0].byteswap().astype(np.uint64), state[1].byteswap().astype(np.uint64)
            out[k] = ((high << np.uint64(28)) | (low >> np.uint64(4))).astype(np.int64)
    for k in np.flatnonzero(blocks > BLOCKS).tolist():
        out[k] = int.from_bytes(hashlib.md5(data[start[k] : end[k]].tobytes()).digest()[:8], "big") >> 4
    return out


def _words(text: bytes) -> bytes:
    """A text's words, each pair with one space between; as in Spark, spaces at the ends are none, other white space is."""
    text = text.strip(b" ").translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def shingle_hashes(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text and hash; a missing text has none."""
    data = np.frombuffer(b"\n".join(b"" if t is None else _words(t) for t in texts) + b"\n", np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    text = np.cumsum(data[ends] == 10) - (data[ends] == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    there = np.array([t is not None for t in texts], bool)[text]
    first = np.flatnonzero((text[: len(text) - width + 1] == text[width - 1 :]) & there[width - 1 :]) if len(text) >= width else np.zeros(0, np.int64)
    hashes, text = hashes60(data, starts[first], ends[first + width - 1]), text[first]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return text[new], hashes[new]


def sets(width: int, most: int | None = None):
    """For mapInArrow: from rows (id, text) to (id, hashes), of each text all hashes of its shingles or the `most` smallest."""

    def cut(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        text, hashes = shingle_hashes(texts, width)
        starts = np.searchsorted(text, np.arange(len(texts) + 1))
        if most is not None:
            hashes = hashes[np.arange(len(text)) - starts[text] < most]
            starts = np.concatenate([[0], np.cumsum(np.minimum(np.diff(starts), most))])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hashes, pa.int64()))], ["id", "hashes"])

    def run(batches):
        for b in batches:
            ids, texts, held = [], [], 0
            for id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = None if not text.is_valid else text.as_buffer().to_pybytes()
                ids.append(id)
                texts.append(text)
                held += len(text or b"")
                if held >= HELD:
                    yield cut(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield cut(ids, texts)

    return run
