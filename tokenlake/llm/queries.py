"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def bpe_files() -> tuple[str, str]:
    """The installed rank file and the pattern that goes with it; the package is at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(_read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    return score(_read(spark, sf_dir, "documents"), held_out="crc32(cast(doc_id AS STRING)) % 10 = 0")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subword import classify

    out = classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), held_out="crc32(cast(doc_id AS STRING)) % 4 = 2", columns=["doc_id"])
    return out.select("row.doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    return read(write(_read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans_tree import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), queries="vec_id % 100 = 0", k=10)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    path, pattern = bpe_files()
    out = decode(encode(_read(spark, sf_dir, "documents"), path, pattern, columns=["doc_id"]), path, pattern)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_read(spark, sf_dir, "documents"), shards=16)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import dedup

    out = dedup(_read(spark, sf_dir, "documents"), columns=["doc_id"], window=20)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .posindex import contamination

    out = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc": op4_warc,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
