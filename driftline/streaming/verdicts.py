"""Scores and the audit of positions that keep up with a growing log of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import judging
from driftline.session import settings, state_on_disk
from driftline.sources import records


def log(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """The verdicts of the JSON-lines files that come into a folder; lines that are none have a null pair_id."""
    schema = records.schema("verdict")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def keep_scores(verdicts: DataFrame, out: str, checkpoint: str) -> None:
    """Take what has come since the last call into the tables ``out``/scores and ``out``/order.

    A verdict counts once for its pair and dimension, and a pair once for its order, however often and
    in whatever order they are delivered; of verdicts that contradict each other the first delivered
    one stands.  What was counted lives in the streams' state, so a call costs what is new.  A call
    without anything new leaves the tables as they are.  Rows without a pair or a dimension are no
    verdicts.
    """
    spark = verdicts.sparkSession
    good = verdicts.where("pair_id is not null and dimension is not null")
    counted = good.dropDuplicates(["pair_id", "dimension"]).groupBy("dimension").agg(*judging.counts())
    shown = good.dropDuplicates(["pair_id"]).groupBy("order").agg(F.count("*").alias("pairs"))

    def scores(batch: DataFrame, _: int) -> None:
        frame = batch.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in records.DIMENSIONS])).alias("dimension"))
        judging.rated(frame, batch, ["dimension"]).coalesce(1).write.mode("overwrite").parquet(f"{out}/scores")  # six rows

    def order(batch: DataFrame, _: int) -> None:
        n = lambda o: F.coalesce(F.sum(F.when(F.col("order") == o, F.col("pairs"))), F.lit(0)).alias(o)
        one = batch.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), *[n(o) for o in records.ORDERS])
        share = F.when(F.col("pairs") > 0, F.col("model_first") / F.col("pairs"))
        one.withColumn("model_first_fraction", share).write.mode("overwrite").parquet(f"{out}/order")

    with settings(spark, **state_on_disk(spark)):
        started = [
            df.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
            for name, df, put in (("scores", counted, scores), ("order", shown, order))
        ]
        for q in started:
            q.awaitTermination()
