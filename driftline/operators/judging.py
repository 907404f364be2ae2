"""Pairwise judging: tasks, verdicts, scores by dimension and the audit of positions."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators.seams import IN_FLIGHT, in_flight
from driftline.sources.records import DIMENSIONS

#: The protocol's judge, calls before giving up and the first pause.
DEFAULT_JUDGE, ATTEMPTS, PAUSE = "gpt-5.4-mini", 3, 0.1


def tasks(pairs: DataFrame, seed: int, by_generator: bool = False) -> DataFrame:
    """Each pair once a dimension, with the order that all its dimensions share."""
    order = tx.order_by_mersenne("pair_id", seed) if by_generator else tx.order_by_hash("pair_id", seed)
    return pairs.withColumn("order", order).withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])))


def candidates(order: Column | str, model: Column, human: Column) -> tuple[Column, Column]:
    """(A, B) of a task."""
    first = tx.col(order) == "model_first"
    return F.when(first, model).otherwise(human), F.when(first, human).otherwise(model)


def rendered(rows: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Tasks with the prompt that the judge gets."""
    named = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    a, b = candidates("order", F.col("model_text"), F.col("human_text"))
    return rows.withColumn("rendered", tx.render_prompt(named[F.col("dimension")], F.col("prompt"), a, b))


VERDICT = "pair_id string, dimension string, judge_model string, order string, raw_response string, choice string, retry_count int, model_won boolean"


def judged(
    rows: DataFrame, factory: Callable[[], Callable[[str, str], str]], model: str = DEFAULT_JUDGE, attempts: int = ATTEMPTS, pause: float = PAUSE,
    workers: int = IN_FLIGHT, per_second: float | None = None,
) -> DataFrame:
    """Verdicts of the rendered tasks; the factory makes each task's client, which takes (prompt, model) and must allow calls from several threads.

    A task has up to ``workers`` calls under way, and starts at most ``per_second`` of them; verdicts
    come in the rows' order all the same.  A failing call is tried again, with pauses that double; a
    reply that can't be read is asked for once more.  What fails in the end is an invalid verdict that
    says so, never an exception.
    """

    def ask(client, prompt: str) -> tuple[str, bool]:
        for k in range(attempts):
            try:
                return client(prompt, model), True
            except Exception as e:  # noqa: BLE001 - whatever a client raises is a failed call
                last = f"[judge-call-failed] {type(e).__name__}: {e}"
                if k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return last, False

    def run(frames):
        client = factory()

        def verdict(r):
            reply, ok = ask(client, r.rendered)
            retries = 0
            if ok and _choice(reply) == "invalid":
                reply, ok = ask(client, r.rendered)
                retries = 1
            choice = _choice(reply) if ok else "invalid"
            won = None if choice == "invalid" else (choice == "A") == (r.order == "model_first")
            return r.pair_id, r.dimension, model, r.order, reply, choice, retries, won

        for pdf in frames:
            out = list(in_flight(verdict, pdf.itertuples(index=False), workers, per_second))
            yield pd.DataFrame(out, columns=["pair_id", "dimension", "judge_model", "order", "raw_response", "choice", "retry_count", "model_won"]).astype({"model_won": object})

    return rows.select("pair_id", "dimension", "order", "rendered").mapInPandas(run, VERDICT)


def _choice(reply: str) -> str:
    letter = reply.strip().rstrip(".").strip().upper()
    return letter if letter in ("A", "B") else "invalid"


def stub_reply(seed: int, *parts: Column | str) -> Column:
    """A stand-in for a judge: a reply decided by hash of (seed, parts), readable in three of four cases."""
    digit = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[tx.col(p).cast("string") for p in parts]).cast("binary")), 1, 1)
    return F.when(digit < "6", "A").when(digit < "c", "b. ").otherwise("unclear")


def verdicts(rows: DataFrame, reply: Column, model: str = DEFAULT_JUDGE) -> DataFrame:
    """Tasks with a reply column become verdicts."""
    out = rows.withColumn("raw_response", reply).withColumn("choice", tx.parse_choice("raw_response"))
    return out.withColumn("model_won", tx.model_won("choice", "order")).withColumn("judge_model", F.lit(model)).withColumn("retry_count", F.lit(0))


def counts() -> list[Column]:
    """Of verdicts: won, lost, unreadable."""
    return [F.count_if("model_won").alias("wins"), F.count_if(~F.col("model_won")).alias("losses"), F.count_if(F.col("choice") == "invalid").alias("invalid")]


def scores(v: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., dimension, wins, losses, invalid, n, win_rate, score): all six dimensions for each group; rate and score null without a valid verdict."""
    by = by or []
    counted = v.groupBy(*by, "dimension").agg(*counts())
    spark = v.sparkSession
    dims = F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension")
    frame = v.select(*by).distinct().select(*by, dims) if by else spark.range(1).select(dims)
    return rated(frame, counted, [*by, "dimension"])


def rated(frame: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``frame`` with their counts, the number of valid verdicts, the share won and the score."""
    out = frame.join(counted, by, "left").na.fill(0, ["wins", "losses", "invalid"]).withColumn("n", F.col("wins") + F.col("losses"))
    rate = F.when(F.col("n") > 0, F.col("wins") / F.col("n"))
    return out.withColumn("win_rate", rate).withColumn("score", 2 * F.col("win_rate"))


def order_audit(v: DataFrame) -> DataFrame:
    """One row: pairs by the order they were shown in; a pair counts once, whatever its dimensions."""
    first = v.groupBy("pair_id").agg(F.min("order").alias("order"))
    out = first.agg(F.count("*").alias("pairs"), F.count_if(F.col("order") == "model_first").alias("model_first"), F.count_if(F.col("order") == "human_first").alias("human_first"))
    return out.withColumn("model_first_fraction", F.when(F.col("pairs") > 0, F.col("model_first") / F.col("pairs")))


def judge_of(v: DataFrame) -> DataFrame:
    """One row: the judge that the verdicts name, ``mixed:`` with all of them, or the default without a verdict; and the number of pairs."""
    named = v.agg(F.array_sort(F.collect_set("judge_model")).alias("m"), F.count_distinct("pair_id").alias("n"))
    name = F.when(F.size("m") == 0, DEFAULT_JUDGE).when(F.size("m") == 1, F.col("m")[0]).otherwise(F.concat(F.lit("mixed:"), F.array_join("m", ",")))
    return named.select(name.alias("judge_model"), "n")
