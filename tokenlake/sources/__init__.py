"""Readers and writers of texts, plans and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexer import Lexer


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, where the input is too small to occupy half of them by its own splits.

    One small file, or one row group, is one task otherwise.  An input of many splits is left as it is: nothing is shuffled at scale.
    """
    spark = df.sparkSession
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size / split < cores / 2 else df


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, data, size): whole files below a folder, one row each."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.col("content").alias("data"), F.col("length").alias("size"))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of texts in any format that Spark reads."""
    return spark.read.format(kind).options(**options).load(path)


def read_split(spark: SparkSession, path: str, lexer: Lexer, delimiter: int) -> DataFrame:
    """(path, data): pieces of files between occurrences of a certified byte, which Spark's readers may then split anywhere.

    A cut stands before the byte, so each piece but a file's first begins with it; here pieces are the lines between, and the byte is a token
    boundary on either side of each.  Only a byte that the token set certifies is taken.
    """
    if not lexer.is_split_point(delimiter):
        raise ValueError(f"the token set does not certify the byte {delimiter:#04x}")
    rows = spark.read.option("lineSep", chr(delimiter)).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("data"))


def write_tokens(tokens: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Tokens, plans or reports as Parquet, CSV or JSON; lexemes are written to CSV as hexadecimal."""
    if kind == "csv":
        tokens = tokens.select(*[F.hex(c).alias(c) if t == "binary" else F.col(c) for c, t in tokens.dtypes])
    tokens.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
