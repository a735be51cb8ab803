"""The cleaning pipeline: documents in, clean and encoded documents out.

Five stages, each written as Parquet and read again: quality classifier, near-duplicates, repeated passages, benchmark passages, and encoding.
All but the last return the columns of documents; text and n_chars change where a passage goes, nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import bpe, posindex, simhash, subword, superkmer
from tokenlake.llm.queries import bpe_files
from tokenlake.llm.shared import workspace

#: None: XXH64, a trained classifier and byte-level BPE are beyond SQL; tests/llm holds each stage's decisions against brute force (the classifier's against held-out labels).
ORACLE_SQL = None
#: A document goes if the probability that it is good is below this.
REJECT = 0.7


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _carried(docs: DataFrame) -> DataFrame:
    """Each row whole, beside its id and its text's hash, so that no column of docs can clash with these."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _hash(F.col("text")).alias("hash"))


def _hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, takes for good ones.

    Null, empty and wordless texts get the constant's probability and are judged by it like any other; a text of any length is judged whole.  Repeated rows and rows
    with a null id are judged row by row.  No labels: every score is 0.5, and all go.  An empty table stays empty; columns with any name pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _back(subword.classify(docs, labels, held_out="false", columns=docs.columns, threshold=REJECT).where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id; of repeated rows one."""
    groups = simhash.similar_groups(docs, shingle=5, similarity=0.8)
    kept = groups.where("doc_id <=> least").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), F.col("group"))
    kept = kept.groupBy("group", "kept_id").agg(F.min("kept_hash").alias("kept_hash")).select("kept_id", "kept_hash").distinct()
    rows = _carried(docs)
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["hash"] == kept["kept_hash"])
    return _back(rows.join(kept, same, "left_semi").dropDuplicates(["id", "hash"]), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that stand earlier, too; a document that loses none stays as it is."""
    out = superkmer.dedup(docs, columns=docs.columns, window=20)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 13 words of `benchmark`, however long they are, that aren't contaminated by shorter items either.

    Null, empty and wordless texts hold no passage and stay; repeated rows go or stay together.  Without items all stay.  An empty table stays empty.
    """
    found = posindex.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    bad = found.where("whole OR contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = _carried(docs)
    return _back(rows.join(bad, rows["id"].eqNullSafe(bad["bad_id"]) & (rows["hash"] == bad["bad_hash"]), "left_anti"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to.

    A null text is encoded like an empty one, to no ids; a text of any length is encoded whole.  One row per row, repeated ones included.
    """
    path, pattern = bpe_files()
    out = bpe.encode_and_decode(docs, path, pattern, columns=["doc_id"])
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
