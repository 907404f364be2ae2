"""Expensive steps in batches: what is finished stays, and a run that is repeated goes on behind it.

A batch is a Spark job of its own whose rows are appended to a sink.  Keys that the sink has are done,
so a run that fails, or is killed, loses the calls of one batch at most, and its repetition makes no
call a second time for what was finished before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.setops import SetError, remaining, strays
from driftline.session import intermediate_path, intermediates
from driftline.streaming.incremental import have

#: Rows of a batch at least, and batches at most, unless a caller knows better what a lost batch may cost: each costs a few seconds whatever is in it.
PER_BATCH, MOST_BATCHES = 1000, 48


@dataclass(frozen=True)
class Done:
    """Keys that were planned, that the sink had before, and that this run finished."""

    planned: int
    before: int
    new: int


def batches(rows: DataFrame, key: str, per_batch: int | None = None) -> Iterator[DataFrame]:
    """``rows`` in parts of about ``per_batch``, dealt by hash of the key; rows of one key stay together.

    Without a size, parts have PER_BATCH rows, and more where there would be over MOST_BATCHES parts.
    The rows are written once, a folder a part, so every part reads its own rows only and stays as it
    was if what ``rows`` came from changes meanwhile.
    """
    spark = rows.sparkSession
    n = rows.count()
    per_batch = per_batch or max(PER_BATCH, math.ceil(n / MOST_BATCHES))
    parts = math.ceil(n / per_batch)
    if not parts:
        return
    path = intermediate_path(spark, "batches")
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    # a large part is several files, so no task writes or reads it alone
    files = F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(math.ceil(per_batch / PER_BATCH)))
    rows.withColumn("_part", part).repartition("_part", files).write.partitionBy("_part").parquet(path)
    own = spark.read.schema(rows.withColumn("_part", part).schema).parquet(path)
    tasks = spark.sparkContext.defaultParallelism
    for k in range(parts):
        # a part may be one file, and its calls are worth spreading
        yield own.where(F.col("_part") == k).drop("_part").repartition(min(tasks, per_batch))


def append(
    planned: DataFrame, sink: str, schema: T.StructType | str, step: Callable[[DataFrame], DataFrame], key: str = "pair_id", per_batch: int | None = None, partition_by: list[str] | None = None,
    others: bool = False,
) -> Done:
    """Run ``step`` over what is planned and not yet in the Parquet ``sink``, batch by batch, and append what it gives.

    ``step`` must give at least one row for each key, with the columns of ``schema``.  A sink with keys
    that the plan lacks belongs to another plan, which is an error before anything is run, unless
    ``others`` may be there.  Planned rows with a null key are an error too, as they would never count
    as done; repeated keys are one.
    """
    spark = planned.sparkSession
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    keys = planned.select(key).distinct()
    if planned.where(F.col(key).isNull()).limit(1).count():
        raise SetError(f"planned rows without {key}")
    done = have(spark, sink, kind).select(key).distinct()
    if others:
        done = done.join(keys, key, "left_semi")
    elif stray := strays(done, keys).limit(5).collect():
        raise SetError(f"{sink} has {key}s that the plan lacks: {sorted(r[0] for r in stray)}")
    before, all_ = done.count(), keys.count()
    with intermediates(spark):
        for rows in batches(remaining(planned.dropDuplicates([key]), done, key), key, per_batch):
            out = step(rows).select(*kind.names).write.mode("append")
            (out.partitionBy(*partition_by) if partition_by else out).parquet(sink)
    return Done(all_, before, all_ - before)
