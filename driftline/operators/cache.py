"""A cache of embeddings: one Parquet table, partitioned by embedder, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import content_sha256
from driftline.operators.progress import batches
from driftline.operators.seams import embedded
from driftline.operators.setops import cache_audit, cache_misses
from driftline.session import intermediates
from driftline.streaming.incremental import have

SCHEMA = T.StructType([T.StructField("content_sha256", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("embedder_id", T.StringType())])


class CacheError(OSError):
    """A cache whose vectors don't fit each other, or its embedder."""


def read(spark: SparkSession, path: str) -> DataFrame:
    return have(spark, path, SCHEMA)


def validate(cache: DataFrame, embedder_id: str) -> int | None:
    """The length of an embedder's vectors (null: none yet); vectors that differ in length, aren't finite, or differ for one content are an error.

    A content that is there twice with one vector is sound: two runs at a time may both have made it.
    """
    own = cache.where(F.col("embedder_id") == embedder_id)
    row = cache_audit(own).first()
    if row is None:
        return None
    differ = 0
    if row["twice"]:
        keyed = own.groupBy("content_sha256").agg(F.min(F.xxhash64("vector")).alias("a"), F.max(F.xxhash64("vector")).alias("b"))
        differ = keyed.where("a <> b").limit(1).count()
    if differ or row["dim_spread"] or row["not_finite"]:
        raise CacheError(f"cache of {embedder_id}: {row.asDict()}")
    return own.select(F.size("vector")).first()[0]


def embed(texts: DataFrame, path: str, embedder_id: str, factory: Callable, key: str = "pair_id", per_batch: int | None = None) -> DataFrame:
    """(key, vector) of all texts; contents that the cache lacks are embedded, each once, and appended first.

    They are appended batch by batch, so what is embedded outlives a failure.  A null text has a null
    vector.  Runs at the same time may embed a content twice, of which every reader takes one.
    """
    spark = texts.sparkSession
    dim = validate(read(spark, path), embedder_id)
    made = 0
    with intermediates(spark):
        for rows in batches(cache_misses(texts, read(spark, path), embedder_id), "content_sha256", per_batch):
            embedded(rows, factory).withColumn("embedder_id", F.lit(embedder_id)).write.mode("append").partitionBy("embedder_id").parquet(path)
            made += 1
    now = validate(read(spark, path), embedder_id) if made else dim
    if dim is not None and now != dim:
        raise CacheError(f"{embedder_id} now gives vectors of length {now}, not {dim}")
    own = read(spark, path).where(F.col("embedder_id") == embedder_id).groupBy("content_sha256").agg(F.first("vector").alias("vector"))
    return texts.withColumn("content_sha256", content_sha256("text")).join(own, "content_sha256", "left").select(key, "vector")
