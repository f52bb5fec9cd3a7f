"""A training-data pipeline over documents: each stage calls one operator of weftline.llm on all that the one before kept.

run() writes each stage's result as Parquet in the shared folder and reads it again; what a stage wrote in between is
deleted then. The last stage returns token ids. In every stage null text counts as empty text, rows without doc_id are
judged like others where the operator can (see each stage), rows that repeat are each kept or dropped alike, an empty
table gives an empty one, and other columns of documents are passed on whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontaminate, jaccard, linededup, quality
from weftline.llm.store import new_path, scratch, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Empty texts are scored like others; rows without doc_id train nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.quality_scores(docs, labels).where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its lines stays with empty text, and null text becomes empty.

    Rows without doc_id keep all their lines. n_chars is counted again.
    """
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates stays, with all rows of that doc_id.

    Empty texts and rows without doc_id are near duplicates of nothing and stay.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; rows without doc_id too. Empty texts stay."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256), a row for each: ids as little-endian unsigned 32-bit integers.

    Empty text has no ids. The ids are written before they are decoded: in one stage each task would hold two Python
    workers, and executors keep their workers from then on.
    """
    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.decode(written(bpe.encode(docs, *how), "token-ids"), *how)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]

#: SQL can't express the classifier's fit; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
