"""The registered queries of this subpackage.

Each ``opN_<name>`` applies its operator with production parameters to its
whole table; the digest columns are derived from the operator's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, edit_fingerprint, exact_dedup, minhash_join, packing, quality, quote_links, secret_scan, substring_dedup, token_alignment, url_filter, warc_salvage, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, shown as mail with nested quotes, linked back."""
    mail = quote_links.as_mail(table(spark, sf_dir, "conversations"))
    return quote_links.link_quotes(mail).withColumn("own_sha256", F.sha2(F.col("own_text").cast("binary"), 256)).drop("own_text")


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets per document, through the blob ledger: one half of
    the rows is an earlier run, then all rows are scanned against its ledger."""
    docs = table(spark, sf_dir, "documents")
    earlier = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ledger = secret_scan.update_ledger(docs, secret_scan.update_ledger(earlier))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    joined = secret_scan.spans_text(spans)
    return secret_scan.findings(docs, ledger).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(joined.cast("binary"), 256).alias("base_sha256"),
        joined.alias("spans"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return edit_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per document: the largest doc_id of equal texts stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


# The rules of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per page url; urls that no rule fits are allowed."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated 35-word windows."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score per document; held-out rows' labels are never read."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between two tokenizers' tokens in all documents."""
    return token_alignment.align_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


#: One page in this many is first written torn, so that the reader has gaps to skip.
TORN_PAGES = 64


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, some of them torn first, and read
    back past the gaps."""
    return warc_salvage.round_trip(table(spark, sf_dir, "pages"), torn=F.col("page_id") % TORN_PAGES == 5)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quote_links, op2_secret_ledger, op3_byte_bpe, op4_minhash_join, op5_edit_fingerprint, op6_exact_dedup, op7_url_filter, op8_substring_dedup, op9_quality, op10_pack,
        op11_whitening, op12_token_alignment, op13_warc_salvage)}
