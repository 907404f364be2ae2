"""Summaries of detector scores and the comparison of a draft's with a rewrite's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators.seams import IN_FLIGHT, in_flight

#: Bins of the histogram over [0, 1], and the rise that counts as a success.
BINS, RISE = 10, 0.30


def scored(texts: DataFrame, factory: Callable[[], Callable[[str], float]], workers: int = IN_FLIGHT) -> DataFrame:
    """(set_id, role, pair_id, text_sha, human_prob); a call that fails or gives no probability fails the whole set."""

    def run(frames):
        client = factory()
        for pdf in frames:
            yield pdf.assign(human_prob=list(in_flight(lambda t: float(client(t)), pdf["text"], workers)))[["set_id", "role", "pair_id", "text", "human_prob"]]

    raw = texts.select("set_id", "role", "pair_id", "text").mapInPandas(run, "set_id string, role string, pair_id string, text string, human_prob double")
    return checked(raw).select("set_id", "role", "pair_id", tx.content_sha256("text").alias("text_sha"), "human_prob")


def checked(rows: DataFrame) -> DataFrame:
    """Rows as they are; an invalid probability is an error when it is reached."""
    fail = F.raise_error(F.concat(F.lit("no probability for "), F.col("pair_id"))).cast("double")
    return rows.withColumn("human_prob", F.when(tx.valid_probability("human_prob"), F.col("human_prob")).otherwise(fail))


def stub_probability(text="text"):
    """A stand-in for a detector: a number in [0, 1) by hash of the text."""
    return F.conv(F.substring(F.md5(tx.col(text).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Accuracy of the sketch that brackets quantiles, how many of its errors a bracket is wide to either side, and ranks that it must be wide.
ACCURACY, ERRORS, RANKS = 50_000, 4, 8


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], accuracy: int = ACCURACY) -> DataFrame:
    """(by..., q): the linear quantiles of each group, exact, without gathering a group's values anywhere.

    A sketch, which merges as it is aggregated, brackets each quantile by rank, so outliers don't widen a
    bracket.  One pass then counts the values below each bracket and, one by one, those inside: a few
    in 10,000 of a group's values, which are put in order; groups so small that a bracket has only a few
    ranks are ordered as they are.  Null values are left out; a group without others has no row.
    """
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    width = ERRORS / accuracy
    ends = [min(1.0, max(0.0, p + w)) for p in shares for w in (-width, width)]
    keys = [f"_e_{c}" for c in by]
    told = v.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(x) for x in ends]), F.lit(accuracy)).alias("_e"))
    told = told.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], "_n", "_e")
    # a share's row: a value inside its bracket, or null for one below; -1 is a group that is ordered whole
    row = lambda k, at: F.struct(F.lit(k).alias("share"), at.alias("at"))
    mine = [
        F.when(F.col("_v") < F.col("_e")[2 * k], row(k, F.lit(None).cast("double"))).when(F.col("_v") <= F.col("_e")[2 * k + 1], row(k, F.col("_v"))) for k in range(len(shares))
    ]
    rows_of = F.when(F.col("_n") * width < RANKS, F.array(row(-1, F.col("_v")))).otherwise(F.array_compact(F.array(*mine)))
    seen = v.join(told, _same(by, keys)).select(*by, "_n", F.explode(rows_of).alias("_x")).select(*by, "_n", "_x.*")
    counted = seen.groupBy(*by, "_n", "share", "at").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "share").orderBy(F.col("at").asc_nulls_first()))
    ranked = counted.withColumn("_to", upto)
    place = lambda k: (F.col("_n") - 1) * F.lit(float(shares[k]))

    def value_at(rank: Column, k: int) -> Column:
        here = F.col("share").isin(k, -1) & (rank >= F.col("_to") - F.col("_k")) & (rank < F.col("_to"))
        return F.max(F.when(here, F.col("at")))

    ends = [value_at(end(place(k)), k).alias(f"_{name}{k}") for k in range(len(shares)) for name, end in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*by, "_n").agg(*ends)
    missed = F.raise_error(F.lit("a quantile is outside of its bracket")).cast("double")

    def linear(k: int) -> Column:
        low, high = F.col(f"_low{k}"), F.col(f"_high{k}")
        between = F.when(low == high, low).otherwise(low + (place(k) - F.floor(place(k))) * (high - low))
        return F.when(low.isNull() | high.isNull(), missed).otherwise(between)

    return found.select(*by, F.array(*[linear(k) for k in range(len(shares))]).alias("q"))


def summary(rows: DataFrame, by: list[str], value: str = "human_prob") -> DataFrame:
    """(by..., n, mean, median, stdev, minimum, maximum, p25, p50, p75, p90) with the population's deviation and linear quantiles."""
    v = F.col(value)
    q = quantiles(rows, by, value, (0.25, 0.5, 0.75, 0.9))
    own = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    q = q.select(*[F.col(c).alias(f"_q_{c}") for c in by], "q")
    out = own.join(q, _same(by, [f"_q_{c}" for c in by]), "left")
    return out.select(*by, "n", "mean", F.col("q")[1].alias("median"), "stdev", "minimum", "maximum", *[F.col("q")[k].alias(f"p{p}") for k, p in enumerate((25, 50, 75, 90))])


def histogram(rows: DataFrame, by: list[str], value: str = "human_prob", bins: int = BINS) -> DataFrame:
    """(by..., bin, n) over [0, 1]: every bin, also without values; 1 falls in the last one, values outside in the nearest."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) * bins))).cast("int")
    counts = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rise(summaries: DataFrame) -> DataFrame:
    """One row: the rewrite's mean less the draft's and whether it is large enough; null unless there is exactly one set of each."""
    role = lambda r: F.col("role") == r
    one = summaries.agg(
        F.count_if(role("instruct_draft")).alias("drafts"), F.count_if(role("rewrite")).alias("rewrites"),
        F.max(F.when(role("instruct_draft"), F.col("mean"))).alias("draft_mean"), F.max(F.when(role("rewrite"), F.col("mean"))).alias("rewrite_mean"),
    )
    clear = (F.col("drafts") == 1) & (F.col("rewrites") == 1)
    delta = F.when(clear, F.col("rewrite_mean") - F.col("draft_mean"))
    return one.select(F.when(clear, F.col("draft_mean")).alias("draft_mean"), F.when(clear, F.col("rewrite_mean")).alias("rewrite_mean"), delta.alias("delta"), (delta >= RISE).alias("passed"))


def nested(rows: DataFrame, value: str = "human_prob") -> DataFrame:
    """Summaries in the shape of the report: one row a set, histogram and quantiles inside."""
    counts = histogram(rows, ["set_id"], value).groupBy("set_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"]).alias("histogram"))
    own = summary(rows, ["set_id", "role"], value)
    return own.join(counts, "set_id").select("set_id", "role", "n", "mean", "median", "stdev", "minimum", "maximum", "histogram", F.struct("p25", "p50", "p75", "p90").alias("quantiles"))


def to_pandas_scores(df: DataFrame) -> pd.DataFrame:
    return df.orderBy("set_id", "pair_id").toPandas()
