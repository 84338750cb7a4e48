"""Training-data pipeline over `documents`: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept,
and returns the columns of `documents`; the last returns packed pieces. An empty table
passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.mixing import mix_sources
from corvane.llm.ngram_join import jaccard_components
from corvane.llm.packing import pack_sequences
from corvane.llm.quality import score_documents, train
from corvane.llm.queries import is_held_out
from corvane.llm.secret_scan import scan_secrets
from corvane.llm.shared import Table, drop_tables, live_tables

#: Documents scored below this are rejected.
LEAST_QUALITY = 0.5
#: The columns that stages read by name; others can have any names.
READ = ("doc_id", "text", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage with the columns that it doesn't read out of the way of those it adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in READ else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


@any_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality; the classifier learns from labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~is_held_out())
    scored = score_documents(docs, train(docs, labels), keep=docs.columns)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


@any_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 over five-word shingles, the document of smallest id stays.

    Of equal rows one stays. Rows that share an id but not their text stay or go
    together; a row without an id stays if its group has no row with one.
    """
    found = jaccard_components(docs, words=5, threshold=0.8)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "text"])


@any_columns
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark of its kind, and n_chars by the new length where the text changed."""
    scanned = scan_secrets(docs, keep=docs.columns, redacted=True)
    changed = F.col("spans") != ""
    n_chars = F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return scanned.select(*({"text": F.col("redacted").alias("text"), "n_chars": n_chars}.get(c, F.col(c)) for c in docs.columns))


@any_columns
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows of equal ids are taken alike; those without words go."""
    mixed = mix_sources(docs, weights=[5, 2, 1], share=1.5)
    copies = mixed.filter("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr("taken div size")).alias("_copies"))
    taken = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: SQL can't express the classifier; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = live_tables()
        out = Table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = out.df
        drop_tables(out, *before)  # what the stage left behind; its input stays for a rerun of lost tasks
    return STAGES[-1][1](spark, docs, sf_dir)
