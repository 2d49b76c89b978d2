"""The corpus pipeline: stages that each apply one operator to all rows of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatescope.llm.common import read_table, written
from estatescope.llm.stages import drop_near_copies, drop_repeats, keep_quality, mix, pack_sequences

STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack_sequences),
]

# SQL cannot express packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
