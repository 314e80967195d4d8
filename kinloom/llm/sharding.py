"""Extendible hashing: shards named by hash-prefix bits, split one bit at a time until each fits.

A row's hash has HASH_BITS bits of the md5 of its id, so the same id always lies in the same shard. The
directory is built from sums by hash cell, not from rows: a bucket whose bytes are above the limit is split
on the next bit, all others keep their depth. Cells that are too large themselves are counted anew on more
bits, from their own rows alone.

A bucket with one row isn't split, however long that row is. Rows that repeat an id share all bits: where
they exceed the limit together they are dealt to numbered pages of one bucket, none above the limit unless it
is a single row's. Rows of up to half the limit fill pages by halves, each longer one has a page of its own, so
there are at most twice as many pages as the bytes need, and two more; numbers may be left out. Null ids hash like empty ones, null contents have no bytes. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.shared import Workspace, columns_checked

HASH_BITS = 60
#: Bits of a cell beyond the depth that even shards would have, and bits added where cells are too large.
SPARE_BITS, MORE_BITS = 4, 8
#: Bits of a row number that count within one part of a bucket's pages: no task sorts more rows of it.
PART_BITS = 16
_ROW = "__sharding_row"


def hash_of(key: Column) -> Column:
    """60 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(cell: Column, bits: int, depth: Column) -> Column:
    """The first `depth` bits of a cell of `bits` bits, as text of 0 and 1."""
    text = F.lpad(F.conv(cell.cast("string"), 10, 2), bits, "0") if bits else F.lit("")
    return F.substring(text, F.lit(1), depth)


def directory(ws: Workspace, rows: DataFrame, max_bytes: int, total: int) -> DataFrame:
    """The shards of rows(h, bytes): (cell_bits, cell, depth, shard, shard_bytes), a row for each cell of a shard."""
    found, above = None, 0
    bits = min(HASH_BITS, max(1, (max(total, 1) // max_bytes)).bit_length() + SPARE_BITS)
    part = rows
    while True:
        shift = HASH_BITS - bits
        cells = part.groupBy(F.shiftright("h", shift).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        deep = F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth")
        up = cells.select("*", deep).withColumn("at", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = up.groupBy("depth", "at").agg(F.sum("bytes").alias("shard_bytes"), F.min("low").alias("l"), F.max("high").alias("u"))
        fits = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("l") == F.col("u"))).select("depth", "at", "shard_bytes")
        best = up.join(fits, ["depth", "at"], "left").groupBy("cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct("depth", "shard_bytes"))).alias("best"))
        here = ws.store(best.select(F.lit(bits).alias("cell_bits"), "cell", F.col("best.depth").alias("depth"), prefix(F.col("cell"), bits, F.col("best.depth")).alias("shard"), F.col("best.shard_bytes").alias("shard_bytes")))
        fine = here.where("depth is not null")
        found = fine if found is None else found.union(fine)
        if bits == HASH_BITS or here.where("depth is null").isEmpty():
            return found
        large = here.where("depth is null").select(F.col("cell").alias("large"))
        part = part.join(large, F.shiftright("h", shift) == F.col("large"), "left_semi")
        above, bits = bits + 1, min(HASH_BITS, bits + MORE_BITS)


def sharded(df: DataFrame, *, max_bytes: int, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Give each row of df its shard: (key, n_bytes, shard, depth, page, shard_bytes), shard '' being the undivided table.

    No content is shuffled. The directory has a few rows for each shard and is joined by AQE's choice.
    """
    return _sharded(df.withColumn(_ROW, F.monotonically_increasing_id()), max_bytes, key, content).drop(_ROW)


def _sharded(df: DataFrame, max_bytes: int, key: str, content: str) -> DataFrame:
    """sharded() of rows that are numbered in _ROW, with their numbers."""
    ws = Workspace(df.sparkSession, "sharding")
    rows = columns_checked(df, {key: "string" if dict(df.dtypes)[key] == "string" else "long", content: "string", _ROW: "long"})
    rows = rows.select(F.col(key), hash_of(F.col(key)).alias("h"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("bytes"), _ROW)
    rows = ws.store(rows)
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first().t
    shards = ws.store(directory(ws, rows, max_bytes, total))
    out, rest = None, rows
    for bits in [r.cell_bits for r in shards.select("cell_bits").distinct().orderBy("cell_bits").collect()]:
        own = shards.where(F.col("cell_bits") == bits).drop("cell_bits")
        cell = F.shiftright("h", HASH_BITS - bits)
        met = rest.withColumn("c", cell).join(own, F.col("c") == F.col("cell")).drop("c", "cell")
        out = met if out is None else out.union(met)
    if out is None:
        out = rows.select("*", F.lit(0).alias("depth"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    over = F.col("shard_bytes") > max_bytes
    paged = _paged(ws.store(out.where(over)), max_bytes)
    whole = out.where(~over).withColumn("page", F.lit(0)).unionByName(paged)
    return whole.select(key, F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "page", "shard_bytes", _ROW)


def _paged(rows: DataFrame, max_bytes: int) -> DataFrame:
    """rows(shard, bytes, _ROW) with their page: running sums of each part of a shard, moved on by the parts before it."""
    small = F.col("bytes") * 2 <= max_bytes
    light, heavy = F.when(small, F.col("bytes")).otherwise(0), F.when(small, 0).otherwise(1)
    own = rows.withColumn("part", F.shiftright(_ROW, PART_BITS))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts, shard = Window.partitionBy("shard").orderBy("part"), Window.partitionBy("shard")
    sums = own.groupBy("shard", "part").agg(F.sum(light).alias("l"), F.sum(heavy).alias("k"))
    sums = sums.select("shard", "part", ahead("l", parts).alias("l0"), ahead("k", parts).alias("k0"), F.sum("l").over(shard).alias("l_all"))
    inside = Window.partitionBy("shard", "part").orderBy(_ROW)
    own = own.withColumns({"l1": ahead(light, inside), "k1": ahead(heavy, inside)}).join(sums, ["shard", "part"])
    half = lambda x: F.floor(x * 2 / max_bytes)
    page = F.when(small, half(F.col("l0") + F.col("l1"))).otherwise(half(F.col("l_all")) + 1 + F.col("k0") + F.col("k1"))
    return own.withColumn("page", page.cast("int")).select(*rows.columns, "page")


def write_shards(df: DataFrame, path: str, *, max_bytes: int, key: str = "doc_id", content: str = "text") -> None:
    """Write df as Parquet, one folder for each shard and page; a shard is one task's file, and no task holds more than a shard.

    The numbered rows are stored once before, so that each keeps its number.
    """
    rows = Workspace(df.sparkSession, "sharding").store(df.withColumn(_ROW, F.monotonically_increasing_id()))
    both = rows.join(_sharded(rows, max_bytes, key, content).select(_ROW, "shard", "page"), _ROW).drop(_ROW)
    both.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
