"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, is written as Parquet and read again. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtrail.llm import langid, line_dedup, minhash, mixing, packing
from labtrail.llm.common import documents, scratch
from labtrail.llm.queries import tokenizer_path, with_domain

#: A source in five domains; no source gives a document twice, and one tenth of the tokens goes.
MIX = mixing.Mix(levels=("domain", "lang", "source"), weights={"lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, share=0.9, max_epochs=1, seed="pipeline")

#: Bytes of rows that go to a Python worker at once: it and the executor each hold a few copies of them.
BATCH_BYTES = "4m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """The stage, in a session that sends its Python workers `BATCH_BYTES` at a time, from then on."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; `lang` becomes the language predicted."""
    judged = langid.identify(docs)
    return judged.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that loses all its lines has nothing left and goes."""
    kept = line_dedup.dedup(docs)
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.representatives(docs)


@small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domains, languages and sources take."""
    return mixing.select(with_domain(docs), MIX).select(*docs.columns)


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    found = packing.pack_documents(docs, tokenizer_path())
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("mix_sources", mixture),
    ("best_fit_packing", packed),
]

#: SQL cannot express fitted models, edit joins and packing; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
