"""Mixing sources to target weights: whole passes first, then a subset whose length sums fit the rest.

Each source's documents are counted by exact length.  A target takes as many whole passes over the
source as fit.  The rest is met by a subset: every length gives the same share of its documents, and
a bounded-knapsack dynamic program over what is left of each length closes the remaining budget,
exactly where the lengths allow it.  Which documents of a length are taken is decided by seeded rank.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut, repeated

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Ranks within a length are counted in parts, so that a common length isn't ranked in one task: so many parts at least, and of about so many rows.
SALTS, SALT_ROWS = 64, 100_000
#: Bits of the knapsack's table at most; a larger rest is first filled down to this.
TABLE = 1 << 23
#: Fixed value: a word is a run of code points other than space, tab, line feed, VT, FF and CR.
WORDS = r"[^\x20\x09-\x0D]+"


def word_total(text: str = "text") -> Column:
    """Number of words of a text, null: 0.  Counts the starts of runs instead of building them."""
    gone = F.translate(F.concat(F.lit(" "), F.coalesce(F.col(text), F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(gone, F.lit(r" [^ ]")).cast("long")


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that their lengths sum up to ``budget`` as nearly as may be, never above.

    An even share of every length comes first; then large lengths fill what is left down to twice the
    largest length, or to TABLE; a bounded-knapsack table closes that.  Its state is one bit per sum, and
    it stops at the first length with which the budget can be met exactly.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    edge = min(2 * int(lengths.max()), TABLE)
    for i in order:
        if left <= edge:
            break
        n = min(int(counts[i] - take[i]), (left - edge) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    if left <= 0:
        return take
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []  # steps: (index, items in this step, the sums reachable before it)
    for i in order[::-1]:
        size, n, power = int(lengths[i]), int(min(counts[i] - take[i], left // int(lengths[i]))), 1
        while n > 0 and not reach >> left & 1:
            k = min(power, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * size)) & mask
            n, power = n - k, power * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight.
    Sorted by size per weight, the sources that stop form a prefix, so one ordered pass finds them.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    full = sizes.withColumn("w", w).withColumn("cap", cap)
    order = [(F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward)
    full = full.withColumn("stops", F.col("cap") <= level * F.col("w")).withColumn("total", total)
    spare = F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("stops"), F.col("w"))).over(whole)
    return full.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(spare * F.col("w") / free).alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """(key, size, source_size, target, taken) per row of ``docs``; taken / size is how often the mix has the row.

    size: words of the text, null and empty: 0.  taken is a multiple of size, at most ``most`` times
    it; rows of size 0 take nothing.  The taken words of a source reach its target rounded down, or
    the nearest sum below that its lengths allow.  Null is a source of its own, the last.  Repeated
    rows count one by one.  Ranks depend on seed, key and size alone, so reruns agree.  No rows: an
    empty frame.  The target of a source without words is 0.  Other columns aren't read.
    """
    rows = cut(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_total(text).alias("size")), "mix-rows")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    # one row a source from here to the join
    aims = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor((F.floor("target")) / F.col("source_size")))).otherwise(0).cast("long")
    aims = cut(aims.withColumn("passes", passes), "mix-targets")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["size"] > 0].sort_values("size")
        sizes, counts = own["size"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        first = pdf.iloc[0]
        budget = int(np.floor(first["target"])) - int(first["passes"]) * int(first["source_size"])
        take = fill(sizes, counts, budget) if len(own) and budget > 0 and first["passes"] < most else np.zeros(len(own), np.int64)
        return pd.DataFrame({"source": own["source"].astype(object).where(own["source"].notna(), None), "size": sizes, "take": take})

    kind = rows.schema["source"].dataType.simpleString()
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
    a = aims.alias("a")
    histogram = lengths.join(a, lengths["source"].eqNullSafe(a["source"])).select(lengths["source"], "size", "n", "source_size", "target", "passes")
    chosen = histogram.groupBy("source").applyInPandas(plan, f"source {kind}, size long, take long").where("take > 0")

    # equal rows are one with a count; the seeded rank of a row within its length is counted by salt
    draw = F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))
    common = lengths.where("size > 0").agg(F.max("n")).first()[0] or 0
    salts = max(SALTS, -(-common // SALT_ROWS))
    equal = rows.where("size > 0").groupBy("source", "size", "key").agg(F.count("*").alias("n"))
    salted = equal.withColumn("draw", draw).withColumn("salt", F.pmod(F.shiftrightunsigned("draw", 3), F.lit(salts)).cast("int"))
    counts = salted.groupBy("source", "size", "salt").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("source", "size").orderBy("salt")
    c = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    t = chosen.alias("t")
    quota = c.join(t, same(c, t, ["source", "size"])).select(
        c["source"], c["size"], c["salt"], F.greatest(F.lit(0), F.least(c["n"], F.col("take") - F.col("before"))).alias("quota")
    ).where("quota > 0")
    inside = Window.partitionBy("source", "size", "salt").orderBy("draw", "key")
    ranked = salted.withColumn("at", F.sum("n").over(inside) - F.col("n"))
    some = ranked.join(quota, same(ranked, quota, ["source", "size", "salt"]), "left").select(
        ranked["key"], ranked["source"].alias("src"), ranked["size"], ranked["n"].alias("times"), F.coalesce(F.col("quota"), F.lit(0)).alias("left"), ranked["at"]
    )
    extra = repeated(some, "times", "nth").select("key", "src", "size", F.when(F.col("at") + F.col("nth") < F.col("left"), 1).otherwise(0).alias("extra")).unionByName(
        rows.where("size = 0").select("key", F.col("source").alias("src"), "size", F.lit(0).alias("extra"))
    )
    out = extra.join(aims, extra["src"].eqNullSafe(aims["source"]))
    return out.select(
        F.col("key").alias(key), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * (F.col("passes") + F.col("extra"))).cast("long").alias("taken"),
    )
