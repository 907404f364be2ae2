"""Job 1: a reference corpus that grows with the documents that come in.

    python -m jobs.ingest --documents IN --corpus OUT --checkpoint STATE [--config jobs/ingest.json]

A file stream takes the document files that are new since the last run and ends when it has taken
them all.  Documents that qualify as human references (words, language, no navigation or legal lines)
are kept, each content once a source, under the first digits of their SHA-256.  What is known lives in
the stream's keyed state, so a run costs what is new, not what there is; Spark's sink commits a
batch's files once, so a run that was killed goes on where it was.  A run without new files changes
nothing.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import text as tx
from driftline.operators import sampling
from driftline.session import settings, ship, state_on_disk
from jobs.common import log, read_config, session

#: What is read of a document file; a file without one of these columns has nulls there.
DOCUMENTS = "text string, lang string, source string"
#: What the corpus holds; ``shard`` is a folder.
CORPUS = "content_sha256 string, source string, text string, word_count long, n_chars long, shard string"


@dataclass(frozen=True)
class Config:
    """Word band of references, digits of the hash that name a folder, and files that one batch takes at most."""

    word_min: int = tx.WORDS_MIN
    word_max: int = tx.WORDS_MAX
    shard_digits: int = 1
    files_per_batch: int = 1000


def stage_of(config: Config) -> F.Column:
    """Why a document is no reference (blank, words, language, boilerplate), or null for one that is; the checks in their order."""
    words = tx.word_count("text")
    return (
        F.when(F.char_length("text") == 0, "blank").when(~words.between(config.word_min, config.word_max), "words")
        .when(~tx.language_ok("lang", "text"), "language").when(tx.boilerplate_heavy("text"), "boilerplate")
    )


def references(documents: DataFrame, config: Config) -> DataFrame:
    """(content_sha256, source, text, word_count, n_chars, shard) of the documents that qualify.  Null texts are blank; a null source is one of its own."""
    good = sampling.qualified(documents, word_min=config.word_min, word_max=config.word_max)
    own = good.select(tx.content_sha256("text").alias("content_sha256"), "source", "text", "word_count", F.char_length("text").cast("long").alias("n_chars"))
    return own.withColumn("shard", F.substring("content_sha256", 1, config.shard_digits))


def ingest(spark: SparkSession, documents: str, corpus: str, checkpoint: str, config: Config | None = None) -> dict[str, int]:
    """Take the new files of the folder ``documents``, or of those that it matches as a pattern, into ``corpus``; returns what was read and written.

    The three places are any that Spark reaches.  ``checkpoint`` belongs to ``corpus``: one without the
    other is an error of the sink.  Other columns are not looked at.
    A text that comes again, in this run or an earlier one, isn't written again for its source.
    """
    config = config or Config()
    ship(spark)
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config.files_per_batch).parquet(documents)
    own = stream.withColumn("text", tx.strip(F.coalesce("text", F.lit(""))))
    counted = own.observe("documents", F.count(F.lit(1)).alias("read"))
    # one row a content and source of those that the state doesn't know
    fresh = references(counted, config).dropDuplicates(["content_sha256", "source"])
    with settings(spark, **state_on_disk(spark)):
        query = (
            fresh.writeStream.format("parquet").option("path", corpus).option("checkpointLocation", checkpoint).partitionBy("shard")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    done = {"batches": 0, "read": 0, "written": 0}
    for p in query.recentProgress:
        seen = p.observedMetrics.get("documents")
        known = sum(s.numRowsUpdated for s in p.stateOperators)  # a row that is new to the state is a row that is written
        done["batches"] += p.numInputRows > 0
        done["read"] += seen["read"] if seen else 0
        done["written"] += known
        log.info("ingest: batch %d: %d documents read, %d texts written, %d known", p.batchId, p.numInputRows, known, sum(s.numRowsTotal for s in p.stateOperators))
    log.info("ingest: %s into %s: %s", documents, corpus, json.dumps(done))
    return done


def read_corpus(spark: SparkSession, corpus: str) -> DataFrame:
    """The corpus as its last committed batch left it."""
    return spark.read.schema(T._parse_datatype_string(CORPUS)).parquet(corpus)


def refused(spark: SparkSession, documents: str, config: Config | None = None) -> DataFrame:
    """(source, reason, n): documents of a folder that are no references, by the first check that they fail."""
    own = spark.read.schema(DOCUMENTS).parquet(documents).withColumn("text", tx.strip(F.coalesce("text", F.lit(""))))
    return own.select("source", stage_of(config or Config()).alias("reason")).where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.ingest", description="Take new document files into the reference corpus.")
    p.add_argument("--documents", required=True)
    p.add_argument("--corpus", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config")
    p.add_argument("--report", help="where to write the documents that were refused, by source and reason")
    a = p.parse_args(argv)
    with session("ingest") as spark:
        config = read_config(spark, Config, a.config)
        done = ingest(spark, a.documents, a.corpus, a.checkpoint, config)
        if a.report:
            refused(spark, a.documents, config).write.mode("overwrite").partitionBy("reason").json(a.report)
    print(json.dumps(done))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
