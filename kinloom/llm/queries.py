"""One query for each operator, opN_<name>, over whole tables with production parameters."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, lines, neardup, packing, secrets, sharding, topk, toxicity, urls, vectors


def vocabulary(name: str) -> str:
    """A public vocabulary file; KINLOOM_TOKENIZERS names another folder than the installed one."""
    folder = os.environ.get("KINLOOM_TOKENIZERS") or os.path.dirname(importlib.util.find_spec("public_tokenizers").origin)
    return os.path.join(folder, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text a shard may have.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)


def byte_vocabulary() -> tuple[str, str, str]:
    """The byte-level vocabulary: the library's file, the ranks file, the splitting pattern."""
    import public_tokenizers

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), byte_vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = toxicity.scored(documents, toxicity.fitted(documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    removed = lines.duplicate_lines(documents).select("row_key", "removed")
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(1 + feeds).cast("long")
    own = documents.select("doc_id", n_lines.alias("n_lines"), neardup.row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return own.join(removed, "row_key", "left").select("doc_id", "n_lines", (F.col("n_lines") - F.size(gone)).alias("n_kept"), gone.alias("removed"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_topk, op3_urls, op4_bpe, op5_minhash, op6_vectors, op7_packing, op8_toxicity, op9_secrets, op10_lines)}

_SHARDS = f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes FROM documents),
d AS (SELECT r.*, x.depth, h >> (60 - x.depth) AS p FROM r, (SELECT unnest(range(0, 33))::INT AS depth) x),
s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes FROM d GROUP BY depth, p HAVING sum(n_bytes) <= {SHARD_BYTES} OR min(h) = max(h)),
m AS (SELECT d.doc_id, d.h, d.n_bytes, min(d.depth) AS depth, max(s.shard_bytes) AS shard_bytes FROM d JOIN s USING (depth, p) GROUP BY d.doc_id, d.h, d.n_bytes)
SELECT doc_id, n_bytes, substr(right(format('{{:060b}}', h), 60), 1, depth) AS shard, depth::INT AS depth, 0::INT AS page, shard_bytes FROM m"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _SHARDS, "op3_urls": urls.oracle()}
