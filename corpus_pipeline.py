"""From documents to packed sequences: toxicity, line dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that
is written as Parquet and read again before the next. All stages but the last return documents' columns.
Extra columns pass through; null texts pass the filters and are packed as their closing id; an empty table
gives no rows. Texts that a stage changes get their n_chars anew, where that column is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import lines, neardup, packing, secrets, toxicity
from kinloom.llm.queries import byte_vocabulary, table
from kinloom.llm.shared import Workspace


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; the model is learned from documents' labels."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal lines one line stays; documents that lose every line go."""
    return _counted(lines.without_lines(docs, lines.duplicate_lines(docs)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles stays."""
    return neardup.firsts(docs, neardup.near_duplicates(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; every document stays."""
    return _counted(secrets.masked(docs))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, in the order of the curve."""
    return packing.packed(docs, byte_vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_dedup", without_near_duplicates),
    ("secrets", without_secrets),
    ("packing", into_sequences),
]

#: SQL can't express the learned score nor the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, ws.store(stage(spark, docs, sf_dir))
        ws.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
