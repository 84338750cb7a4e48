"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.chat import SEARCH, events_of_turns, format_chat
from corvane.llm.embed_dedup import link_embeddings
from corvane.llm.fingerprint import fingerprint_documents
from corvane.llm.mixing import mix_sources
from corvane.llm.ngram_join import jaccard_components
from corvane.llm.oracles import ORACLES
from corvane.llm.packing import pack_sequences
from corvane.llm.quality import score_documents, train
from corvane.llm.secret_scan import scan_secrets
from corvane.llm.suffix_dedup import dedup_spans
from corvane.llm.token_counts import count_tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(events_of_turns(_read(spark, sf_dir, "conversations")), SEARCH)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"), words=3, threshold=0.9)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(_read(spark, sf_dir, "embeddings"), least=0.98)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def is_held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = train(docs, _read(spark, sf_dir, "labels").filter(~is_held_out()))
    return score_documents(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_read(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(_read(spark, sf_dir, "documents"), depth=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_chat_formatting,
        op3_ngram_jaccard_join,
        op4_embedding_near_dedup,
        op5_token_counts,
        op6_quality_classifier,
        op7_secret_scans,
        op8_document_fingerprints,
        op9_mixing,
        op10_suffix_array_dedup,
    )
}

__all__ = ["ORACLES", "QUERIES", "is_held_out"]
