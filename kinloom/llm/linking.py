"""Links between similar sets by MinHash: minima, banding, signature verification, exact verification.

A row's set has PERMUTATIONS universal hash minima, in BANDS bands of equal size. Rows that share a
band are candidates; a pair at the threshold itself shares none with a probability below 1e-7 at the
document setting. Candidates whose signatures differ by more than chance allows are put aside (below
1e-6 at the threshold), the rest are verified on their full sets.

Only what joins components is verified. First each row of a band meets the band's first row, and in a large
band a few neighbours; inside an Arrow batch the rows of a band beyond CROWD send one row for all of them to the shuffle. Then the other
pairs of small bands whose ends are still in different components are tried. The rows of large bands that
hold several components meet through an exact prefix filter: of each set only the rarest shingles are
indexed, as many as two linked sets can't avoid to share, and pairs are formed only where size and place
in that order leave room for the threshold and the components differ. So no link between two components
is lost, however large the band, no group yields its pairs, and no task holds more than a block of an index list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.shared import Workspace, components, tidied, touched

#: Kinds of rows that bands make.
STAR, SMALL, MEMBER = 0, 1, 2
CROWD = 16
#: How far on in a larger band are the rows that a row meets besides the first.
CHAIN = (1, 2)
#: Band keys that a worker holds at once, about.
KEYS_AT_ONCE = 500_000
#: Rows of one group that are compared with each other in a task.
BLOCK = 4000
#: Hash buckets in which shingles of crowds are counted, as a power of two; the driver and the workers hold one byte of each.
BUCKET_BITS = 18
PARITY_BITS = 512
SLICE_BYTES = 1 << 21
#: Elements of sets that are intersected at once.
ELEMENTS = 2_000_000
#: Bits of a shingle's code; the rest of a signed number is for the place of a row in its batch.
CODE_BITS = 50
#: Rows whose places fit beside a code.
AT_ONCE = (1 << (63 - CODE_BITS)) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Setting:
    """Linked: den * intersection >= num * union."""

    num: int = 80
    den: int = 100
    bands: int = 32
    width: int = 4

    @property
    def permutations(self) -> int:
        return self.bands * self.width

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(20240501)
        a = draw.integers(0, 1 << 32, self.permutations, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        return a, draw.integers(0, 1 << 32, self.permutations, dtype=np.uint64).astype(np.uint32)

    def least_matches(self) -> int:
        """Equal signature places that a linked pair has but for about one in a million."""
        j, n = self.num / self.den, self.permutations
        return max(0, int(j * n - 5 * (j * (1 - j) * n) ** 0.5))


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of all hash functions over one set of 32-bit numbers."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        h = a[:, None] * x[None, k : k + 4096]
        h += b[:, None]
        np.minimum(out, h.min(1), out=out)
    return out


def band_keys(mins: np.ndarray, setting: Setting) -> np.ndarray:
    """(rows, bands) 64-bit keys from (rows, permutations) minima."""
    grouped = mins.reshape(len(mins), setting.bands, setting.width).astype(np.uint64)
    key = np.broadcast_to(mixed(np.arange(1, setting.bands + 1, dtype=np.uint64)), grouped.shape[:2]).copy()
    for k in range(setting.width):
        key = mixed(key * _MIX + grouped[:, :, k])
    return key.view(np.int64)


def signature(mins: np.ndarray) -> np.ndarray:
    """One byte of each minimum."""
    return (mixed(mins.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def combined(keys: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """What a batch's rows send: their band keys in bytes, and lists of their pivots and of the crowds they are in.

    keys (rows, bands). Rows of one key beyond CROWD + 1 don't send it: they are linked to the key's first row and some neighbours and marked in its crowd.
    """
    n, bands = keys.shape
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(ordered)]]))
    large, size = starts[sizes > CROWD], sizes[sizes > CROWD]
    member = np.repeat(large - np.cumsum(size) + size, size) + np.arange(size.sum())
    at, place = order[member], np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    sent = np.ones(n * bands, bool)
    sent[at[place > CROWD]] = False
    row, first = at // bands, np.repeat(order[large] // bands, size)
    near = [np.stack([row, first], 1)] + [np.stack([row[k:], row[:-k]], 1)[place[k:] >= k] for k in CHAIN]
    star = np.concatenate(near)
    star = np.unique(star[ids[star[:, 0]] != ids[star[:, 1]]], axis=0)
    return (
        packed_rows(flat[sent], sent.reshape(n, bands).sum(1)),
        lists(star[:, 0], ids[star[:, 1]], n),
        lists(row, flat[at], n),
    )


def packed_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each row's run of 64-bit numbers as bytes."""
    offsets = 8 * np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The list of values of each of n rows."""
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].astype(np.int64)))


def packed(buckets: int):
    """From rows (id, keys) to the keys and ids of each hash bucket of a batch, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            ids = np.repeat(b.column(0).to_numpy(), np.asarray(pc.binary_length(b.column(1))) // 8)
            to = (mixed(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            keys, ids, to = keys[order], ids[order], to[order]
            starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            for k in range(0, len(starts), 10_000):
                cut = list(zip(starts[k : k + 10_000], np.append(starts, len(to))[k + 1 : k + 10_001]))
                columns = [pa.array(to[starts[k : k + 10_000]]), *(pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (keys, ids))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "ids"])

    return run


def run_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what packed() made, sorted by bucket: (kind, a, b).

    STAR: a band's first row and another one, or, in a band of more than CROWD, neighbours in it; SMALL: two other rows of a band of at most CROWD; MEMBER: a larger band's key and a row.
    """
    bucket, held, many = None, [], 0
    for b in batches:
        for now, *both in zip(*(c.to_pylist() for c in b.columns)):
            if now != bucket and held:
                yield from _bands(held)[0]
                held, many = [], 0
            bucket = now
            held.append([np.frombuffer(x, np.int64) for x in both])
            many += len(held[-1][0])
            if many > 2 * KEYS_AT_ONCE:  # what came of very large bands is sent on, some rows of each stay
                found, held = _bands(held, crowds_only=True)
                yield from found
                many = min(len(held[0][0]), KEYS_AT_ONCE)
    if held:
        yield from _bands(held)[0]


def _bands(held: list, crowds_only: bool = False) -> tuple[Iterator[pa.RecordBatch], list]:
    keys, ids = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    alone = np.ones(len(keys) + 1, bool)
    alone[1:-1] = ordered[1:] != ordered[:-1]
    shared = order[~(alone[:-1] & alone[1:])]
    order = shared[np.lexsort((ids[shared], keys[shared]))]
    k, i = keys[order], ids[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    k, i = k[keep], i[keep]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(k)]]))
    crowd = np.repeat(sizes > CROWD, sizes)
    first = np.repeat(i[starts], sizes) if len(k) else i
    other = (i != first) & (crowd if crowds_only else True)
    parts = [(STAR, first[other], i[other]), (MEMBER, k[crowd], i[crowd])]
    for on in CHAIN:
        same = crowd[on:] & (k[on:] == k[:-on])
        parts.append((STAR, i[:-on][same], i[on:][same]))
    for size in range(3, 0 if crowds_only else CROWD + 1):
        rows = i[starts[sizes == size][:, None] + np.arange(1, size)]
        x, y = np.triu_indices(size - 1, 1)
        parts.append((SMALL, rows[:, x].ravel(), rows[:, y].ravel()))
    if crowds_only:
        drop = set(k[crowd & (np.arange(len(k)) - np.repeat(starts, sizes) > CROWD)].tolist())
        rest = ~np.isin(keys, np.fromiter(drop, np.int64, len(drop)))
        few = crowd & np.isin(k, np.fromiter(drop, np.int64, len(drop))) & (np.arange(len(k)) - np.repeat(starts, sizes) <= CROWD)
        held = [[np.concatenate([keys[rest], k[few]]), np.concatenate([ids[rest], i[few]])]]

    def sent():
        for kind, a, b in parts:
            for at in range(0, len(a), 100_000):
                n = len(a[at : at + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(a[at : at + n]), pa.array(b[at : at + n])], ["kind", "a", "b"])

    return sent(), held


@dataclass
class Candidates:
    """stars and small: distinct pairs (a, b), a < b; crowds: members (key, id) of large bands; all stored but small."""

    stars: DataFrame
    small: DataFrame
    crowds: DataFrame
    tables: tuple[DataFrame, ...]


def candidates(ws: Workspace, sketched: DataFrame) -> Candidates:
    """What bands have in common, from sketched(id, keys, pivots, crowds)."""
    buckets = 1 + sketched.select(F.sum(F.length("keys"))).first()[0] // (8 * KEYS_AT_ONCE) if not sketched.isEmpty() else 1
    bands = sketched.select("id", "keys").mapInArrow(packed(buckets), "bucket int, keys binary, ids binary")
    found = ws.store(bands.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run_bands), "kind byte, a long, b long"))
    batch = sketched.select("id", F.explode("pivots").alias("p")).where("id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    stars = ws.store(found.where(f"kind = {STAR}").select("a", "b").union(batch).distinct())
    inside = sketched.select(F.explode("crowds").alias("key"), "id")
    crowds = ws.store(found.where(f"kind = {MEMBER}").select(F.col("a").alias("key"), F.col("b").alias("id")).union(inside).distinct())
    small = found.where(f"kind = {SMALL}").select("a", "b").distinct()
    return Candidates(stars, small, crowds, (found, stars, crowds))


def between(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components; part(id, component) has the rows that are linked at all."""
    at = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"{c}_of"))
    placed = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return placed.where(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")


def near_signatures(pairs: DataFrame, signatures: DataFrame, setting: Setting) -> DataFrame:
    """The pairs (a, b) whose set sizes, where known, and signatures allow the threshold; signatures(id, [n,] sig)."""
    least, num, den = setting.least_matches(), setting.num, setting.den
    size = F.col("n") if "n" in signatures.columns else F.lit(1)
    one = signatures.select(F.col("id").alias("a"), size.alias("na"), F.col("sig").alias("sa"))
    two = signatures.select(F.col("id").alias("b"), size.alias("nb"), F.col("sig").alias("sb"))

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(x.num_rows, -1) for i in (2, 3))
            good = (sa == sb).sum(1) >= least
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(good)), x.column(1).filter(pa.array(good))], ["a", "b"])

    both = pairs.join(one, "a").join(two, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return both.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def crowd_pairs(ws: Workspace, crowds: DataFrame, part: DataFrame, texts: DataFrame, sets, setting: Setting) -> DataFrame:
    """Pairs (a, b) of rows in crowds of several components that the exact prefix filter can't rule out.

    A set's shingles are ordered by how often they are among these rows, counted in BUCKETS hash buckets: any
    order that is the same for all sets gives right results, one that puts rare shingles first gives few pairs.
    Pairs are formed where size and place leave room for the threshold, and so do the sets' parities: the
    shingles' counts modulo two in PARITY_BITS buckets, which differ at most as often as the sets do.
    """
    member = crowds.join(part, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rows = ws.store(member.join(several, "key", "left_semi").select("id", "component").distinct())
    if rows.isEmpty():
        return crowds.select(F.col("key").alias("a"), F.col("id").alias("b")).limit(0)
    own = ws.store(touched(texts, rows, "id")[0].join(rows, "id").select("id", "component", "text"))
    shift, num, den = CODE_BITS - BUCKET_BITS, setting.num, setting.den

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for x in sliced(batches, 0):
            codes, _, _ = sets(x.column(0).to_pylist())
            total += np.bincount(codes >> shift, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], ["bucket", "c"])

    counted = own.select("text").mapInArrow(tidied(count), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    level = np.zeros(1 << BUCKET_BITS, np.uint8)
    level[counted.column("bucket").to_numpy()] = 1 + (8 * np.log2(counted.column("c").to_numpy())).astype(np.int64).clip(0, 250)

    def index(batches):
        for x in sliced(batches, 2):
            ids, component = (x.column(i).to_numpy() for i in (0, 1))
            codes, borders, _ = sets(x.column(2).to_pylist())
            n = np.diff(borders)
            row = np.repeat(np.arange(len(n)), n)
            rank = level[codes >> shift]
            order = np.lexsort((codes, rank, row))
            place = np.arange(len(codes)) - borders[row]
            # a linked set shares ceil(n * num / den) of n, hence one of the others and one more; what is alone in its bucket has no partner
            use = (place <= n[row] - (n[row] * num + den - 1) // den) & (rank[order] > 1)
            row, place, code = row[use], place[use], codes[order][use]
            for k in range(0, len(code), 100_000):
                r = row[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(code[k : k + 100_000]), pa.array(ids[r]), pa.array(component[r]), pa.array(n[r].astype(np.int32)), pa.array(place[k : k + 100_000].astype(np.int32))], ["code", "id", "component", "n", "place"])

    listed = ws.store(own.select("id", "component", "text").mapInArrow(tidied(index), "code long, id long, component long, n int, place int"))
    # an entry needs a partner of another component, and one small enough for what is left of its set
    room = (F.col("n") - F.col("place")) * (num + den) >= num * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * num / den)))
    for _ in range(2):
        open_ = listed.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.count("*").alias("c")).where("lo <> hi").drop("lo", "hi")
        kept = listed.drop("least", "c").join(open_, "code").where(room)
        before, listed = listed, ws.store(kept)
        kept = listed
        ws.drop(before)

    def parities(batches):
        for x in sliced(batches, 1):
            codes, borders, _ = sets(x.column(1).to_pylist())
            cell = np.repeat(np.arange(x.num_rows), np.diff(borders)) * PARITY_BITS + codes % PARITY_BITS
            odd = (np.bincount(cell, minlength=x.num_rows * PARITY_BITS) & 1).astype(np.uint8).reshape(x.num_rows, PARITY_BITS)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([y.tobytes() for y in np.packbits(odd, 1)], pa.binary())], ["id", "parity"])

    listed = listed.join(own.select("id", "text").mapInArrow(tidied(parities), "id long, parity binary"), "id")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = listed.select("code", "id", "component", "n", "place", "parity", blocks.alias("blocks")).withColumn("at", own_block)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("code", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "component", "n", "place", "parity")
    found = dealt.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j").mapInArrow(_joined(num, den), "a long, b long")
    pairs = ws.store(found.distinct())
    ws.drop(rows, own, kept)
    return pairs


def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most AT_ONCE rows and about SLICE_BYTES of text in a column."""
    for b in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)) if b.num_rows else ()
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
            end = min(max(end, at + 1), at + AT_ONCE)
            yield b.slice(at, end - at)
            at = end


def _joined(num: int, den: int):
    """From index entries sorted by (code, i, j) to the pairs that may be linked."""

    def pairs(x: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, at, ids, component, n, place, parity = x
        na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
        ok = (component[a] != component[b]) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
        ok &= (num + den) * np.minimum(na - place[a], nb - place[b]) >= num * (na + nb)
        ok &= (i[a] == j[a]) | (at[a] != at[b])
        a, b = a[ok], b[ok]
        apart = np.concatenate([np.zeros(0, np.int64)] + [np.bitwise_count(parity[a[k : k + 50_000]] ^ parity[b[k : k + 50_000]]).sum(1, dtype=np.int64) for k in range(0, len(a), 50_000)])
        ok = (num + den) * apart <= (den - num) * (n[a].astype(np.int64) + n[b])
        a, b = ids[a[ok]], ids[b[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    def compared(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(x[0]):
            return
        new = np.zeros(len(x[0]), bool)
        new[0] = True
        for c in x[:3]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(new)]]))
        out = []
        for size in range(2, CROWD + 1):
            first = starts[sizes == size]
            i, j = np.triu_indices(size, 1)
            step = max(1, ELEMENTS // len(i))
            for k in range(0, len(first), step):
                out.append(pairs(x, (first[k : k + step, None] + i).ravel(), (first[k : k + step, None] + j).ravel()))
        for s, size in zip(starts[sizes > CROWD], sizes[sizes > CROWD]):
            for k in range(s, s + size, step := max(1, ELEMENTS // int(size))):
                some = np.arange(k, min(s + size, k + step))
                a, b = np.repeat(some, s + size - k), np.tile(np.arange(k, s + size), len(some))
                out.append(pairs(x, a[a < b], b[a < b]))
        both = np.stack([np.concatenate(y) for y in zip(*out)], 1) if out else np.zeros((0, 2), np.int64)
        both = np.unique(both, axis=0)
        for k in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[k : k + 100_000, 0]), pa.array(both[k : k + 100_000, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy() for c in b.columns[:-1]] + [np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint64).reshape(b.num_rows, -1)])
            rows += b.num_rows
            if rows < 50_000:
                continue
            now = [np.concatenate(c) for c in zip(*held)]
            same = np.ones(rows, bool)
            for c in now[:3]:
                same &= c == c[-1]
            last = int(np.argmax(same))
            yield from compared([c[:last] for c in now])
            held, rows = [[c[last:] for c in now]], rows - last
        if held:
            yield from compared([np.concatenate(c) for c in zip(*held)])

    return run


def wanted_only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts(id, ...) whose ids are among wanted(id)."""
    return touched(texts, wanted, "id")[0].join(wanted.select("id").distinct(), "id", "left_semi")


def coded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sets of distinct hashes as one array of CODE_BITS-bit codes, its borders, and the codes' range.

    Two of a pair's shingles get one code with a probability below 1e-9 for a thousand shingles.
    """
    borders = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return (flat >> np.uint64(64 - CODE_BITS)).astype(np.int64), borders, 1 << CODE_BITS


def common_counts(codes: np.ndarray, borders: np.ndarray, many: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k], some ELEMENTS at a time."""
    size = np.diff(borders)
    out, load = np.zeros(len(a), np.int64), np.cumsum(size[a] + size[b])
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + ELEMENTS, "right")))
        end = min(end, at + AT_ONCE)
        sets, pair = np.concatenate([a[at:end], b[at:end]]), np.tile(np.arange(end - at), 2)
        n = size[sets]
        where = np.arange(int(n.sum())) + np.repeat(borders[sets] - np.cumsum(n) + n, n)
        key = np.sort(np.repeat(pair, n) * many + codes[where], kind="stable")  # two sorted runs: merged, not sorted anew
        out[at:end] = np.bincount(key[1:][key[1:] == key[:-1]] // many, minlength=end - at)
        at = end
    return out


def verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[list[str]], tuple[np.ndarray, np.ndarray, int]], setting: Setting) -> DataFrame:
    """The pairs (u, v) that are linked by their full sets; texts(id, text), best few others, has each id of a pair once.

    sets: from texts to their sets in the form of coded().
    """
    num, den = setting.num, setting.den
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for x in batches:
            ids = np.concatenate([x.column(i).to_numpy() for i in (0, 1)])
            _, first, at = np.unique(ids, return_index=True, return_inverse=True)
            n = x.num_rows
            one, two = (iter(x.column(2 + side).take(pa.array(first[(first >= n) == side] - side * n)).to_pylist()) for side in (0, 1))
            codes, borders, many = sets([next(two if second else one) for second in (first >= n).tolist()])
            a, b = at[:n], at[n:]
            size, common = np.diff(borders), common_counts(codes, borders, many, a, b)
            good = pa.array((common * den >= (size[a] + size[b] - common) * num) & (common > 0))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(good), x.column(1).filter(good)], ["u", "v"])

    return both.select("a", "b", "ta", "tb").mapInArrow(tidied(run), "u long, v long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def linked(ws: Workspace, found: Candidates, signatures: DataFrame, texts: DataFrame | None, sets, setting: Setting, copies: DataFrame | None = None) -> DataFrame:
    """Edges (u, v), stored, whose components are those of all links; found's tables are dropped.

    signatures(id, [n,] sig) has each candidate, and its text too where texts(id, text) is None; copies(u, v): edges known beforehand.
    """
    wanted = ends(found.stars).union(found.crowds.select("id")).union(ends(found.small)).distinct()
    wanted = ws.store(wanted)
    own = ws.store(wanted_only(signatures, wanted).dropDuplicates(["id"]))
    text = own.select("id", "text") if texts is None else ws.store(wanted_only(texts, wanted).dropDuplicates(["id"]))
    near = near_signatures(found.stars, own, setting)
    edges = verified(near, text, sets, setting)
    edges = ws.store(edges if copies is None else edges.union(copies))
    part = components(ws, edges)
    crowded = crowd_pairs(ws, found.crowds, part, text, sets, setting)
    rest = between(found.small, part).union(crowded).distinct()
    near = ws.store(near_signatures(rest, own, setting))
    rest_text = touched(text, ends(near), "id")[0]
    ws.drop(part, crowded, wanted, *found.tables)
    more = edges if near.isEmpty() else ws.store(verified(near, rest_text, sets, setting).union(edges))
    ws.drop(near, own, text, *([] if more is edges else [edges]))
    return more
