"""Append-only runs that go on where they stopped: file streams into a sink, each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import settings, state_on_disk


def documents(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    """An unbounded source of the files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def have(spark: SparkSession, sink: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The sink's rows; none before the first batch."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sink)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).format(kind).load(sink) if there else spark.createDataFrame([], schema)


def append_new(stream: DataFrame, sink: str, checkpoint: str, key: str = "pair_id", step: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Run what has come since the last call to its end; returns the number of new rows.

    One row of each key goes through ``step``, which must keep rows one by one, into the Parquet
    ``sink``.  The keys that were seen live in the stream's state on disk, so a call costs what is new,
    however much the sink holds; the sink takes each batch's files once, also if a batch is repeated
    after a failure.  A null key is a key.
    """
    fresh = stream.dropDuplicates([key])
    with settings(stream.sparkSession, **state_on_disk(stream.sparkSession)):
        query = (
            (step(fresh) if step else fresh).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return sum(s.numRowsUpdated for p in query.recentProgress for s in p.stateOperators)


def progress(spark: SparkSession, sink: str, schema: T.StructType, planned: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: planned, done and left keys of a run."""
    done = have(spark, sink, schema).select(key).distinct().withColumn("done", F.lit(True))
    return planned.select(key).distinct().join(done, key, "left").agg(F.count("*").alias("planned"), F.count_if("done").alias("done"), F.count_if(F.col("done").isNull()).alias("left"))
