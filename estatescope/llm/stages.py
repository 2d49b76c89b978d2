"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatescope.llm.common import written
from estatescope.llm.jaccard_join import distinct_documents
from estatescope.llm.mixing import mixed_documents
from estatescope.llm.packing import pack, token_pieces
from estatescope.llm.quality import quality_documents
from estatescope.llm.repeated_windows import unrepeated_documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their frequent lines."""
    return quality_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return distinct_documents(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of windows that start earlier too."""
    return unrepeated_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return pack(written(token_pieces(docs), "pieces"))
