"""Views of the input tables in the terms of the domain: pairs, rounds, sets, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.session import ship

CORPUS = "web"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pair_id(number) -> F.Column:
    return F.format_string(f"{CORPUS}-%05d", number)


def pairs_of(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """(pair_id, conv_id, prompt, reference_text): a conversation's first user turn and the document of the same id."""
    prompts = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    docs = documents.select("doc_id", F.col("text").alias("reference_text"))
    return prompts.join(docs, F.col("conv_id") == F.col("doc_id")).select(pair_id(F.col("conv_id")).alias("pair_id"), "conv_id", "prompt", "reference_text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"))


def rounds_of(conversations: DataFrame) -> DataFrame:
    """(pair_id, k, text): assistant turns in order; round 0 is the draft."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = conversations.where("role = 'assistant'").withColumn("k", F.row_number().over(w) - 1)
    return own.select(pair_id(F.col("conv_id")).alias("pair_id"), "k", "text")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds_of(table(spark, sf_dir, "conversations"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(spark, sf_dir).where("k = 0").select("pair_id", "text")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("pair_id", F.col("reference_text").alias("text"))


#: The same views in DuckDB SQL.
SQL = """
WITH prompts AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id),
pairs AS (
  SELECT printf('web-%05d', conv_id) AS pair_id, conv_id, prompt, text AS reference_text FROM prompts JOIN documents ON conv_id = doc_id
),
rounds AS (
  SELECT printf('web-%05d', conv_id) AS pair_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS k, text
  FROM conversations WHERE role = 'assistant'
),
drafts AS (SELECT pair_id, text FROM rounds WHERE k = 0),
refs AS (SELECT pair_id, reference_text AS text FROM pairs)
"""
