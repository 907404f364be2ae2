"""Rewriting in rounds with gates between them: over stored rounds by window, and live in batched rounds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators.seams import IN_FLIGHT, in_flight
from driftline.sources.records import RecordError

#: Rounds that may be asked for, and without asking.
ROUNDS_MIN, ROUNDS_MAX, ROUNDS_DEFAULT = 1, 4, 2


def check_rounds(k: int) -> int:
    if not ROUNDS_MIN <= k <= ROUNDS_MAX:
        raise ValueError(f"rounds must be {ROUNDS_MIN} to {ROUNDS_MAX}, not {k}")
    return k


def examined(rounds: DataFrame, requested: int) -> DataFrame:
    """(pair_id, k, text, report) of stored rounds up to ``requested``, each checked against the round before; round 0 is the draft.

    Up to the first trip every round before is a good one, and rounds behind it are not run, so the
    round before is the last good one wherever it matters.
    """
    w = Window.partitionBy("pair_id").orderBy("k")
    own = rounds.where(F.col("k") <= requested).withColumn("prior_length", F.lag(F.char_length("text")).over(w))
    return own.withColumn("report", F.when(F.col("k") > 0, tx.degeneration("text", F.col("prior_length"))))


def executed(rounds: DataFrame, requested: int) -> DataFrame:
    """:func:`examined` rounds of k >= 1 that are run: none behind a pair's first trip."""
    all_ = examined(rounds, requested).where("k > 0")
    first = F.min(F.when(F.col("report.hard_tripped"), F.col("k"))).over(Window.partitionBy("pair_id"))
    return all_.withColumn("first_trip", first).where("first_trip is null or k <= first_trip")


def outcomes(rounds: DataFrame, requested: int) -> DataFrame:
    """(pair_id, executed, final_round, hard_tripped, flags) a pair with a draft: the last executed round's report; without one all is clean."""
    done = executed(rounds, requested).groupBy("pair_id").agg(
        F.count("*").alias("executed"), F.max("first_trip").alias("first_trip"), F.max("k").alias("last"), F.max_by("report", "k").alias("report")
    )
    drafts = rounds.where("k = 0").select("pair_id")
    out = drafts.join(done, "pair_id", "left")
    final = F.coalesce(F.col("first_trip") - 1, F.col("last"), F.lit(0)).cast("int")
    return out.select(
        "pair_id", F.coalesce("executed", F.lit(0)).cast("long").alias("executed"), final.alias("final_round"),
        F.coalesce("report.hard_tripped", F.lit(False)).alias("hard_tripped"), F.coalesce(F.array_join("report.flags", ","), F.lit("")).alias("flags"),
    )


def round_sets(rounds: DataFrame, requested: int) -> DataFrame:
    """(k, pair_id, text): good rounds, the sets that are scored; a round that no pair reached has no rows."""
    return executed(rounds, requested).where(~F.col("report.hard_tripped")).select("k", "pair_id", "text")


def run_summary(rounds: DataFrame, requested: int, done: DataFrame | None = None, skipped: int = 0) -> DataFrame:
    """One row: pairs, already_done, rewritten, skipped_truncated, flagged_degenerate."""
    own = outcomes(rounds, requested)
    before = own.select("pair_id").limit(0) if done is None else done.select("pair_id")
    marked = own.join(before.distinct().withColumn("was", F.lit(True)), "pair_id", "left")
    return marked.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("was").isNotNull()).alias("already_done"), F.count_if(F.col("was").isNull()).alias("rewritten"),
        F.lit(skipped).cast("long").alias("skipped_truncated"), F.count_if("hard_tripped").alias("flagged_degenerate"),
    )


def rewritten(texts: DataFrame, factory: Callable[[], Callable[[str, int], str]], k: int, workers: int = IN_FLIGHT) -> DataFrame:
    """(pair_id, text) after one batched round; a pair without a text that isn't blank is an error, not a trip."""

    def run(frames):
        client = factory()
        for pdf in frames:
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "text": list(in_flight(lambda t: client(t, k), pdf["text"], workers))})

    made = texts.select("pair_id", "text").mapInPandas(run, "pair_id string, text string")
    fail = F.raise_error(F.concat(F.lit(f"round {k}: no text for "), F.col("pair_id"))).cast("string")
    return made.select("pair_id", F.when(F.char_length(tx.strip(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(fail).alias("text"))


def run(drafts: DataFrame, factory: Callable[[], Callable[[str, int], str]], requested: int, save: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(pair_id, k, text, report) of all rounds that are run, the draft as round 0.

    One batched step a round over the pairs that are left, not one a pair.  ``save`` writes a round and
    gives it back as read, so that no round is run twice.
    """
    check_rounds(requested)
    alive = drafts.select("pair_id", "text")
    out = alive.select("pair_id", F.lit(0).alias("k"), "text", F.lit(None).cast(tx.DEGENERATION).alias("report"))
    for k in range(1, requested + 1):
        new = rewritten(alive, factory, k).join(alive.select("pair_id", F.char_length("text").alias("prior_length")), "pair_id")
        done = save(new.select("pair_id", F.lit(k).alias("k"), "text", tx.degeneration("text", F.col("prior_length")).alias("report")), k)
        out = out.unionByName(done)
        alive = done.where(~F.col("report.hard_tripped")).select("pair_id", "text")
    return out


def bundles(rounds: DataFrame, prompts: DataFrame, run_id: str, adapter: str, config: dict[str, str], requested: int, model: str) -> DataFrame:
    """One nested record a pair: draft, all executed rounds, final round, the last report and the configuration that was asked for."""
    own = executed(rounds, requested)
    listed = own.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "text", F.col("report.flags").alias("flags"), F.col("report.hard_tripped").alias("hard_tripped")))).alias("rounds"),
        F.max_by("report", "k").alias("degeneration"),
    )
    draft = rounds.where("k = 0").select("pair_id", F.struct("text", F.lit(model).alias("model_id")).alias("draft"))
    named = F.create_map(*[F.lit(x) for kv in (config | {"seed_applied": "false"}).items() for x in kv])
    return (
        draft.join(outcomes(rounds, requested).select("pair_id", "final_round"), "pair_id").join(listed, "pair_id", "left").join(prompts.select("pair_id", "prompt"), "pair_id")
        .select(F.lit(run_id).alias("run_id"), "pair_id", "prompt", "draft", "rounds", "final_round", "degeneration", F.lit(adapter).alias("adapter_id"), named.alias("config"), F.lit(requested).alias("requested_k"))
    )


def stale_rounds(names: DataFrame, requested: int) -> DataFrame:
    """Artifacts (name) of rounds that a shorter run leaves behind."""
    return names.where(tx.round_of_artifact("name") > requested)


def drafted(prompts: DataFrame, factory: Callable[[], Callable[[str, float, float, int], str]], seed: int, temperature: float = 0.7, top_p: float = 0.95, workers: int = IN_FLIGHT) -> DataFrame:
    """(pair_id, text, seed) of (pair_id, prompt), each with a seed of its own; a blank draft is an error."""

    def run_(frames):
        client = factory()
        for pdf in frames:
            texts = list(in_flight(lambda x: client(x[0], temperature, top_p, int(x[1])), zip(pdf["prompt"], pdf["seed"], strict=True), workers))
            if blank := [i for i, t in zip(pdf["pair_id"], texts, strict=True) if not (t or "").strip()]:
                raise RecordError(f"no draft for {blank[:5]}")
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "text": texts, "seed": pdf["seed"]})

    return prompts.withColumn("seed", tx.pair_seed("pair_id", seed)).select("pair_id", "prompt", "seed").mapInPandas(run_, "pair_id string, text string, seed long")


def generated(prompts: DataFrame, done: DataFrame, factory: Callable[[], Callable[[str, float, float, int], str]], seed: int, temperature: float = 0.7, top_p: float = 0.95) -> DataFrame:
    """:func:`drafted` pairs of those that have no draft yet."""
    return drafted(prompts.join(done.select("pair_id"), "pair_id", "left_anti"), factory, seed, temperature, top_p)
