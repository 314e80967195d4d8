"""Exact BPE by backtracking: Aho-Corasick token matches and a pair-compatibility test.

A word is cut left to right. At each place the longest vocabulary token that starts there is
tried; it stands if it is compatible with the token before it, that is, if merging the two tokens'
own bytes would give just these two tokens. If not, its next shorter prefix is tried, and where
none fits the last token is taken back. The places that were given up are remembered, so the work
is linear in the word. The result equals the merges applied in rank order.

Decoding gathers bytes from one buffer of all token strings through an offset table.

Null texts count as empty; empty texts have no tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from kinloom.llm.shared import bounded_batches, columns_checked

UNSPELLED = "the vocabulary can't spell this word"
#: Marks a word's last byte, as its symbol in the vocabulary differs from that inside a word.
LAST = 0x1000
#: Words whose ids a worker remembers; beyond it the memory is emptied and the ids found anew.
REMEMBERED = 600_000
#: Pairs whose compatibility a worker remembers.
PAIRS_REMEMBERED = 400_000
#: Texts with any of these characters are normalised and split by the library; on all others this module's own splitting agrees.
ODD = re.compile("[^\x00-\x1b\x20-˿‐-‧]")
#: Words that the vocabulary spells as they are.
SHOWN = re.compile("[!-~]*")
SPELLED = re.compile("[^\t-\r -~]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a lower-casing word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, file: str):
        spec = json.load(open(file, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.end, self.special = end, {t["content"]: t["id"] for t in spec["added_tokens"]}
        merged = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in model["merges"]}
        ids = [i for t, i in vocab.items() if t not in self.special]
        first = min(merged, default=len(vocab))
        if sorted(merged) != list(merged) or any(i >= first and i not in merged for i in ids):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.pairs = {ab: c for c, ab in merged.items()}
        self.halves = {i: merged.get(i, (i, i)) for i in ids}
        self.size, self.automaton = {}, ahocorasick.Automaton()
        text = {}
        for t, i in vocab.items():
            if t in self.special:
                continue
            s = t[: -len(end)] if t.endswith(end) and len(t) > len(end) else t
            s = s[:-1] + chr(LAST + ord(s[-1])) if s is not t else s
            text[i], self.size[i] = s, len(s)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        by_text = {s: i for i, s in text.items()}
        self.shorter = {i: next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), None) for i, s in text.items()}
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(words)
        self.known: dict[str, tuple[int, ...]] = {}
        self.table: dict[tuple[int, int], bool] = {}
        self.symbols = byte_symbols()
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(file)
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        # the library has no decoder for this file: it joins the token strings by spaces
        parts = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across their border comes before the merges that made them."""
        pairs, halves, limit = self.pairs, self.halves, 1 << 62
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given as the vocabulary spells its bytes."""
        if not word:
            return ()
        s = word[:-1] + chr(LAST + ord(word[-1]))
        size, longest = self.size, [None] * len(s)
        for stop, i in self.automaton.iter(s):
            start = stop + 1 - size[i]
            if longest[start] is None or size[longest[start]] < size[i]:
                longest[start] = i
        out: list[int] = []
        table, shorter = self.table, self.shorter
        open_ends, at, token = bytearray(b"\1" * (len(s) + 1)), 0, longest[0]
        while token is not None:
            last = out[-1] if out else None
            while True:
                stop = at + size[token]
                if open_ends[stop] and last is not None and (fits := table.get((last, token))) is None:
                    if len(table) > PAIRS_REMEMBERED:
                        table.clear()
                    fits = table[last, token] = self.compatible(last, token)
                if open_ends[stop] and (last is None or fits):
                    out.append(token)
                    at, token = stop, longest[stop] if stop < len(s) else None
                    break
                if shorter[token] is not None:
                    token = shorter[token]
                    continue
                open_ends[at] = 0
                if last is None:
                    raise ValueError(UNSPELLED)
                out.pop()
                at, token = at - size[last], last
                break
            if token is None and at < len(s):
                raise ValueError(UNSPELLED)
        if at < len(s):
            raise ValueError(UNSPELLED)
        return tuple(out)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, spelled in the vocabulary's symbols."""
        if ODD.search(text):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        found = self.words.findall(text.lower())
        return [w if SHOWN.fullmatch(w) else "".join(map(self.symbols.__getitem__, w.encode())) for w in found] if SPELLED.search(text) else found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit numbers."""
        ids = []
        for part in self.cuts.split(text or "") if self.cuts and text and "<" in text else [text or ""]:
            if part in self.special:
                ids.append((self.special[part],))
                continue
            words, known = self.split(part), self.known
            for w in set(words).difference(known):
                known[w] = self.word(w)
            ids += [known[w] for w in words]
            if len(known) > REMEMBERED or len(part) > 1_000_000:
                known.clear()
        return np.array(list(chain.from_iterable(ids)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: each token's bytes, found by the offset table."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + lengths, lengths)
        return self.buffer[where].tobytes()[:-1]


_LOADED: dict[str, WordBpe] = {}


def loaded(file: str) -> WordBpe:
    if file not in _LOADED:
        _LOADED[file] = WordBpe(file)
    return _LOADED[file]


def encoded(df: DataFrame, file: str, *, keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text of df(doc_id, text).

    Returns per row doc_id, n_tokens, ids (little-endian unsigned 32-bit, absent without keep_ids),
    ids_sha256 and decoded_sha256. No shuffle; a batch is bounded by bytes, a text is never cut.
    Rows that repeat come back as often; a null doc_id stays null; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def run(batches):
        bpe = loaded(file)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                raw = ids.tobytes()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), raw if keep_ids else None))
            n, a, b, raw = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return columns_checked(df, {"doc_id": "long", "text": "string"}).mapInArrow(run, fields)
