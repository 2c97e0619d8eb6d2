"""A training corpus in five stages, each one operator of ``veilframe.llm``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is
written as Parquet and is the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import mix_sources, near_dedup, pack, phrase_dedup, quality
from veilframe.llm.common import shared_path


def _columns(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_quality(docs, quality.fit(docs, labels), out_col="__score")
    return scored.where("__score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that start earlier in the corpus."""
    return _columns(phrase_dedup.without_repeated_phrases(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_sources.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 2048 tokens."""
    return pack.pack_documents(docs)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("mix", mix), ("pack", pack_sequences)]

#: Learned scores and token ids are beyond SQL; tests/llm checks stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
