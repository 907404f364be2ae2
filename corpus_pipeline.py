"""The training-data pipeline: language ID, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and reread
as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import stages
from driftline.llm.common import cut, table

STAGES = [
    ("language", stages.language),
    ("near_dedup", stages.near_dedup),
    ("mixing", stages.mix_sources),
    ("encode", stages.encode),
]

#: The language profiles and the seeded mix are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
