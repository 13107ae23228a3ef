"""A training corpus from raw documents: language filter, near-duplicate filter, mix of sources, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from airlog.llm import language, mixing, pieces, simhash
from airlog.llm.common import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is not rejected by the language model learned from the documents with a language."""
    return language.accepted(docs, language.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The two best segmentations of each document of the mix: (doc_id, source, nbest)."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), n=2, keep=("doc_id", "source"))


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("mix", mix), ("pieces", segment)]

#: Learned centroids, hashes and n-best search have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
