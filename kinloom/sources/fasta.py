"""FASTA and FASTQ files, plain or gz, as tables; lists of files; a size probe of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files with one item in each record.
SUFFIXES = (".fna", ".fa", ".fasta")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, comment, sequence, length) of every record.

    Records are split by the reader itself, so a file is cut into tasks where it isn't compressed.
    """
    raw = spark.read.text(paths, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), "value")
    record = F.regexp_replace("value", r"^>|\r", "")
    head = F.regexp_extract(record, r"^[^\n]*", 0)
    rows = raw.select("file", head.alias("head"), F.regexp_replace(F.substring(record, F.length(head) + 1, F.length(record)), r"\s", "").alias("sequence"))
    return _named(rows.where("head <> '' or sequence <> ''"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, comment, sequence, length) of four-line records; qualities are dropped."""
    raw = spark.read.text(paths, lineSep="\n@").select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"^@|\r", ""), "\n").alias("p"))
    # a quality line may begin with the mark too: such a piece has no plus line in its place
    return _named(raw.where(F.get("p", F.lit(2)).startswith("+")).select("file", F.get("p", F.lit(0)).alias("head"), F.get("p", F.lit(1)).alias("sequence")))


def _named(rows: DataFrame) -> DataFrame:
    name, comment = F.regexp_extract("head", r"^\S*", 0), F.regexp_extract("head", r"^\S*\s+(.*)$", 1)
    return rows.select("file", F.when(name == "", "noName").otherwise(name).alias("name"), F.when(comment == "", "noComment").otherwise(comment).alias("comment"), "sequence", F.length("sequence").cast("long").alias("length"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files that a list names, a path in each line. The driver sees the paths alone."""
    paths = [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]
    return read_fasta(spark, paths)


def suffix_ok(path: str) -> bool:
    return path.removesuffix(".gz").endswith(SUFFIXES)


def numbered(records: DataFrame, *, by_file: bool, least: int = 10_000) -> DataFrame:
    """(id, name, comment, sequences, length) of items of `least` letters or more, one for each file or record.

    ids are 60 bits of the hash of the file's or record's name.
    """
    if by_file:
        items = records.groupBy("file").agg(F.min_by("name", "name").alias("name"), F.min_by("comment", "name").alias("comment"), F.sort_array(F.collect_list("sequence")).alias("sequences"), F.sum("length").alias("length"))
        key = F.col("file")
    else:
        items, key = records.withColumn("sequences", F.array("sequence")), F.concat_ws("\t", "file", "name", "comment", "sequence")
    ids = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
    return items.where(F.col("length") >= least).select(ids.alias("id"), "name", "comment", "sequences", "length")
