"""The corpus pipeline: ``documents`` -> packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last keep the columns of ``documents``.  Nulls,
empty texts, repeated rows, empty tables and extra columns are handled as the
stages' operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwright.llm import exact_dedup, minhash_join, packing, quality, secret_scan
from shelfwright.session import remove_folder, scratch_path, scratch_scope


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier scores below 0.7."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles,
    likeness 0.8 or more) stays, the smallest doc_id."""
    return minhash_join.drop_near_copies(docs, threshold=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, no document goes."""
    return secret_scan.redact(docs, secret_scan.blob_findings(secret_scan.update_ledger(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("secret scan", secrets), ("packing", pack)]

#: The classifier's scores and the tokenizer's ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again.  What a
    stage writes on its way goes when it ends, its own table when the next
    one's is there."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch_scope(spark, "stage"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
