"""Secrets in texts, and whose they are: spans by regular expressions, kept apart by how widely a value is copied.

Base kinds are assign, access and hex; the method adds tokens, long mixed runs that belong to a single owner.
Every candidate's value is counted over the corpus by distinct repositories (documents, copies of a text being
one) and owners (sources): a value that COPIED_OWNERS owners or COPIED_DOCUMENTS documents or more share is a
copied example, any other looks live. All is expressed in
DataFrame functions; only span positions and value hashes are shuffled, never texts.

Null and empty texts have no span. Rows without an id get base spans and tokens like any other and count for
their owner; rows that repeat an id each come back, with spans of their own text. Positions are code points, the end exclusive. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.kmers import bound
from kinloom.llm.shared import Workspace, touched

COPIED_OWNERS, COPIED_DOCUMENTS = 3, 100
KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9_-]{20,}"
LEAST_VALUE = 6
#: Spans of a text that are put in place in one go.
SPANS_AT_ONCE = 256
_JOIN, _LIVE = ("__secrets_h1", "__secrets_h2"), "__secrets_live"


def spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Array of (start, kind_no, kind, end, value) of a pattern's leftmost matches that don't overlap."""
    rx, no = F.lit(pattern), KINDS.index(kind)
    values = F.regexp_extract_all(text, rx, F.lit(value_group))
    sizes = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    one = "struct<start: int, kind_no: int, kind: string, end: int, value: string>"
    none = F.expr(f"cast(array() as array<{one}>)")
    each = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value"))

    def step(state, x):
        start = state["at"] + x["gap"]
        found = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.when(x["size"].isNull(), state).otherwise(F.struct((start + x["size"]).alias("at"), F.concat(state["out"], F.array(found)).alias("out")))

    def join(state, part):
        moved = F.struct(state["at"].alias("at"), part["out"].alias("out"))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def shifted(part):
        return F.transform(part["out"], lambda x: F.struct((x["start"] + part["at"]).alias("start"), x["kind_no"].alias("kind_no"), x["kind"].alias("kind"), (x["end"] + part["at"]).alias("end"), x["value"].alias("value")))

    # arrays grow by copying: places are summed up within blocks, then over the blocks
    def located(found: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / SPANS_AT_ONCE).cast("int"))
        blocks = F.transform(first, lambda k: F.aggregate(F.slice(found, k * SPANS_AT_ONCE + 1, F.lit(SPANS_AT_ONCE)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<at: int, out: array<{one}>>>)").alias("out"))
        return F.aggregate(blocks, start, join, lambda x: F.flatten(F.transform(x["out"], shifted)))

    return F.when(text.rlike(pattern), bound(each, located)).otherwise(none)


def _mixed_token(value: Column) -> Column:
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9].*[0-9]")


def _row_key(key: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text; rows of equal texts have equal spans, so those that share it share all."""
    number, text = F.col(f"`{key}`").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(F.coalesce(number, F.lit(0)), number.isNull(), text), F.xxhash64(text, F.lit(2))


def extracted(df: DataFrame, key: str = "doc_id", owner: str = "source") -> DataFrame:
    """(key, owner, h1, h2, base, token): each row's key, base spans by place and token candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{owner}`").cast("string").alias("owner"), *(h.alias(n) for h, n in zip(_row_key(key), ("h1", "h2"))), text.alias("body"))
    rows = rows.select("key", "owner", "h1", "h2", spans(F.col("body"), "assign", ASSIGN, 2).alias("a"), spans(F.col("body"), "access", ACCESS).alias("c"), spans(F.col("body"), "hex", HEX).alias("h"), spans(F.col("body"), "token", TOKEN).alias("t"))
    kept = F.filter("a", lambda s: F.length(s["value"]) >= LEAST_VALUE)
    base = F.array_sort(F.concat(kept, F.col("c"), F.col("h")))
    return rows.select("key", "owner", "h1", "h2", base.alias("base"), F.filter("t", lambda s: _mixed_token(s["value"])).alias("token"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, owners, repositories) of every candidate value, from extracted rows; a repository is a distinct text."""
    each = found.select("h2", "owner", F.explode(F.concat("base", "token")).alias("s")).select("h2", "owner", F.xxhash64("s.value").alias("h"))
    by_owner = each.groupBy("h", "owner", "h2").count().groupBy("h", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secrets(df: DataFrame, *, key: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Each row's spans: (key, base, added, live), arrays of (start, kind_no, kind, end, value).

    added: tokens of a single owner that no base span covers; live: base and added spans whose value isn't a copied example.
    """
    return _judged(df, key, owner, copied_owners).select(F.col("key").alias(key), "base", "added", "live")


def _judged(df: DataFrame, key: str, owner: str, copied_owners: int) -> DataFrame:
    """(key, h1, h2, base, added, live) of each row: a value is judged over the corpus, spans are those of the row's text.

    Candidates are rows of their own here, so that a text's many spans and values meet by sorting, not each with each.
    """
    found = Workspace(df.sparkSession, "secrets").store(extracted(df, key, owner))
    each = found.where("size(base) + size(token) > 0").select("h1", "h2", F.explode(F.concat("base", "token")).alias("s")).distinct()
    each = each.select("h1", "h2", "s", F.xxhash64("s.value").alias("h"))
    is_token = F.col("s.kind_no") == KINDS.index("token")
    known = each.join(ownership(found), "h").withColumn("alive", (F.col("owners") < copied_owners) & (F.col("repositories") < COPIED_DOCUMENTS))
    text, base = Window.partitionBy("h1", "h2").orderBy("s.start", "s.end", "s.kind_no"), F.when(~is_token, F.col("s"))
    before = F.max(base["end"]).over(text.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base["start"]).over(text.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("s.start")) & F.coalesce(after >= F.col("s.end"), F.lit(True))
    known = known.withColumn("added", is_token & F.col("alive") & (F.col("owners") == 1) & free)
    live = F.col("added") | (~is_token & F.col("alive"))
    lists = known.where(F.col("added") | live).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.when(F.col("added"), F.col("s")))).alias("added"), F.array_sort(F.collect_list(F.when(live, F.col("s")))).alias("live"))
    none = F.slice("base", 1, 0)
    return found.join(lists, ["h1", "h2"], "left").select("key", "h1", "h2", "base", F.coalesce("added", none).alias("added"), F.coalesce("live", none).alias("live"))


def listed(of: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and the list of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        key, *(count(k) for k in KINDS[:3]), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("live").cast("long").alias("n_live"),
    )


def masked(df: DataFrame, *, key: str = "doc_id", owner: str = "source", mask: str = "<secret>") -> DataFrame:
    """df with every live-looking span of its text replaced; all columns stay, copied examples stay too."""
    found = _judged(df, key, owner, COPIED_OWNERS).where("size(live) > 0").select(F.col("h1").alias(_JOIN[0]), F.col("h2").alias(_JOIN[1]), F.col("live").alias(_LIVE)).dropDuplicates([*_JOIN])
    some, others = touched(df.withColumns(dict(zip(_JOIN, _row_key(key)))), found, _JOIN[0])
    both = some.join(found, [*_JOIN], "left")
    text, live = F.col("text"), F.col(_LIVE)

    def step(state, s):
        start = F.greatest(state["at"], s["start"])
        gap = F.substring(text, state["at"] + 1, start - state["at"])
        return F.when(s["end"] <= state["at"], state).otherwise(F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.when(s["start"] >= state["at"], F.lit(mask)).otherwise(F.lit(""))).alias("out")))

    new = F.aggregate(live, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    names = [f"`{c}`" for c in df.columns]
    return others.select(*names).unionByName(both.withColumn("text", F.when(live.isNull(), text).otherwise(new)).select(*names))
