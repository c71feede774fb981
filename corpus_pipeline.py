"""The training-data pipeline: each stage reads what the one before it kept.

`run` writes each stage's result as Parquet in the shared folder and reads it again, so a stage restarts from its
input alone and no plan spans two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import bestfit, jaccard, leaks, lines, quality
from plantpulse.llm.common import saved

STAGES = [
    ("quality rules", quality.stage),
    ("line dedup", lines.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", leaks.stage),
    ("best-fit packing", bestfit.stage),
]

# Packing and the metric join have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
