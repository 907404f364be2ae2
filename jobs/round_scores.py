"""Job 2: every rewriting round scored against the human references.

    python -m jobs.round_scores --conversations IN --documents IN --scores OUT [--rounds 1 2] [--config jobs/round_scores.json]

A conversation's assistant turns are its draft and the rounds after it.  A round's set is what passed
the gates up to it; it is compared with the references of the same pairs by token frequencies, kernel
discrepancy of embeddings and a judge's win rates, and a detector's mean and the share of degenerate
rewrites go beside that.  All rounds share one pass a metric.  Scores are written a folder a round.
Without ``--rounds`` the whole table is replaced, so rounds that no longer exist go; with it only the
named rounds' folders are, and a named round without texts says so with 0 pairs.  A run that is
repeated, or repeated after a failure, gives the same table.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import cascade, detection, judging, metrics, seams
from driftline.plans import bindings
from driftline.session import cut, intermediates, ship
from jobs.common import log, read_config, session

#: ``k`` is a folder.
SCORES = "metric string, value double, n long, k int"


@dataclass(frozen=True)
class Config:
    """Seed of the shown orders, bandwidth of the kernel, the last round that counts, and decimals that are kept."""

    seed: int = 7
    bandwidth: float = 1.0
    last_round: int = cascade.ROUNDS_MAX
    decimals: int = 9


@dataclass(frozen=True)
class Instruments:
    """What measures: a judge's reply, an embedding and a detector's probability as columns; stand-ins by default.

    A judge's reply sees k, pair_id, dimension and order; the others see text.
    """

    reply: Callable[[int], Column] = lambda seed: judging.stub_reply(seed, "k", "pair_id", "dimension")
    embedding: Callable[[], Column] = seams.stub_embedding
    detector: Callable[[], Column] = detection.stub_probability


def scored_sets(rounds: DataFrame, references: DataFrame, config: Config) -> DataFrame:
    """(k, pair_id, text, reference_text): drafts as round 0 and the good rewrites of each round, of pairs with a reference."""
    good = rounds.where("k = 0").select("k", "pair_id", "text").unionByName(cascade.round_sets(rounds, config.last_round))
    return good.join(references.select("pair_id", "reference_text"), "pair_id")


def long(df: DataFrame, name: str | Column, value: str, n: str) -> DataFrame:
    """Rows of the table of scores."""
    return df.select("k", (F.lit(name) if isinstance(name, str) else name).alias("metric"), F.col(value).cast("double").alias("value"), F.col(n).cast("long").alias("n"))


def measured(rounds: DataFrame, references: DataFrame, config: Config, instruments: Instruments, wanted: list[int] | None = None) -> DataFrame:
    """(k, metric, value, n) of all rounds, or the wanted ones.

    Values are null where nothing can be said: no valid verdict, fewer than two pairs for the kernel.
    """
    asked = (lambda df: df.where(F.col("k").isin(*wanted))) if wanted is not None else (lambda df: df)
    sets = asked(cut(scored_sets(rounds, references, config), "round-sets"))  # read by every metric
    sizes = sets.groupBy("k").agg(F.count("*").alias("pairs"))
    if wanted is not None:
        sizes = rounds.sparkSession.createDataFrame([(k,) for k in wanted], "k int").join(sizes, "k", "left").na.fill(0, ["pairs"])
    both = sets.select("k", "pair_id", F.lit("a").alias("side"), "text").unionByName(sets.select("k", "pair_id", F.lit("b").alias("side"), F.col("reference_text").alias("text")))
    l2 = metrics.token_l2(both, ["k"]).join(sizes, "k")
    # the kernel needs two pairs
    paired = both.join(sizes.where("pairs > 1").select("k"), "k", "left_semi")
    vectors = paired.select("k", "side", F.concat("side", "pair_id").alias("id"), instruments.embedding().alias("v"))
    mmd = sizes.join(metrics.mmd2(vectors, "k", "side", "v", "id", sigma=config.bandwidth).select("k", "mmd2"), "k", "left")
    verdicts = judging.verdicts(judging.tasks(sets.select("k", "pair_id"), config.seed), instruments.reply(config.seed))
    jmq = judging.scores(verdicts, ["k"])
    seen = sets.select("k", instruments.detector().alias("p")).groupBy("k").agg(F.avg("p").alias("mean"), F.count("*").alias("texts"))
    run = asked(cascade.executed(rounds, config.last_round)).groupBy("k").agg(F.count("*").alias("executed"), F.count_if("report.hard_tripped").alias("tripped"))
    share = run.withColumn("share", F.col("tripped") / F.col("executed"))
    parts = [
        long(sizes, "pairs", "pairs", "pairs"), long(l2, "token_l2", "token_l2", "pairs"), long(mmd, "mmd2", "mmd2", "pairs"),
        long(jmq, F.concat(F.lit("jmq_"), F.col("dimension")), "score", "n"), long(seen, "detector_mean", "mean", "texts"), long(share, "degenerate_share", "share", "executed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.round("value", config.decimals) + F.lit(0.0))


def round_scores(
    spark: SparkSession, conversations: str, documents: str, scores: str, config: Config | None = None, rounds: list[int] | None = None, instruments: Instruments | None = None
) -> dict[str, int]:
    """Score the rounds of ``conversations`` against ``documents`` into ``scores``, a folder a round; returns what was read and written.

    Columns that the domain doesn't know are not looked at.  Conversations without a document of the
    same id, and null ids, have no reference and count only as rewrites that were run.
    """
    config = config or Config()
    ship(spark)
    conv, docs = spark.read.parquet(conversations), spark.read.parquet(documents)
    pairs, all_rounds = bindings.pairs_of(conv, docs), bindings.rounds_of(conv.where("conv_id is not null"))
    with intermediates(spark):
        found = measured(all_rounds, pairs, config, instruments or Instruments(), rounds)
        # a round has a handful of rows
        writer = found.repartition("k").write.mode("overwrite").option("partitionOverwriteMode", "static" if rounds is None else "dynamic")
        writer.partitionBy("k").parquet(scores)
    own = read_scores(spark, scores)
    done = own if rounds is None else own.where(F.col("k").isin(*rounds))
    told = {r["k"]: r["pairs"] for r in done.where("metric = 'pairs'").select("k", F.col("n").alias("pairs")).collect()}
    for k, n in sorted(told.items()):
        log.info("round_scores: round %d: %d pairs", k, n)
    out = {"turns": conv.count(), "documents": docs.count(), "rounds": len(told), "pairs": sum(told.values()), "written": done.count()}
    log.info("round_scores: %s, %s into %s: %s", conversations, documents, scores, json.dumps(out))
    return out


def read_scores(spark: SparkSession, scores: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(SCORES)).parquet(scores)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.round_scores", description="Score rewriting rounds against the human references.")
    p.add_argument("--conversations", required=True)
    p.add_argument("--documents", required=True)
    p.add_argument("--scores", required=True)
    p.add_argument("--rounds", type=int, nargs="+", help="only these rounds; by default all, and the whole table is replaced")
    p.add_argument("--config")
    a = p.parse_args(argv)
    with session("round_scores") as spark:
        print(json.dumps(round_scores(spark, a.conversations, a.documents, a.scores, read_config(spark, Config, a.config), a.rounds)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
