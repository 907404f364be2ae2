"""Qualified documents, bounded pools, seeded samples and splits.

Two modes: by hash, where every row decides from its key and the order of hashes makes the sample,
and by the seeded generator of Python's random module, for the same draw as a sequential program's.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.session import cut

#: Sizes of the tiers, and how many times the target the pool holds, at least how many rows.
TIERS = {"smoke": 50, "judged": 400, "full": 2000}
POOL_FACTOR, POOL_LEAST = 10, 500


class ShortageError(RuntimeError):
    """Fewer documents qualify than were asked for."""

    def __init__(self, requested: int, available: int) -> None:
        super().__init__(f"{requested} documents asked for, {available} qualify")
        self.requested, self.available = requested, available


def qualified(docs: DataFrame, text: str = "text", lang: str = "lang", word_min: int = tx.WORDS_MIN, word_max: int = tx.WORDS_MAX) -> DataFrame:
    """``docs`` with stripped text and word_count, only those in the word band, in English and not heavy with boilerplate.

    The cheap checks come first; a label decides the language where there is one.  Words are counted
    once, only in texts that passed these and are long enough to hold ``word_min`` words.
    """
    out = docs.withColumn(text, tx.strip(F.coalesce(F.col(text), F.lit(""))))
    # words are a character at least and have one between them
    out = out.where(F.col(lang).isNull() | (F.col(lang) == "en")).where(F.char_length(text) >= max(1, 2 * word_min - 1))
    out = out.where(tx.let(tx.word_count(text), lambda n: n.between(word_min, word_max)))
    out = out.where(tx.language_ok(lang, text)).where(~tx.boilerplate_heavy(text))
    return out.withColumn("word_count", tx.word_count(text))


def pool_cap(target: int) -> int:
    return max(target * POOL_FACTOR, POOL_LEAST)


def pool(docs: DataFrame, target: int, order: str) -> DataFrame:
    """The first rows in order, as many as the pool of ``target`` holds."""
    return docs.orderBy(order).limit(pool_cap(target))


def sample_by_hash(rows: DataFrame, target: int, seed: int, key: str) -> DataFrame:
    """``target`` rows with the smallest hashes, with position from 0."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    few = rows.withColumn("_draw", draw).orderBy("_draw", key).limit(target)
    return few.withColumn("position", F.row_number().over(Window.orderBy("_draw", key)) - 1).drop("_draw")


def places(rows: DataFrame, order: str) -> DataFrame:
    """``rows``, written, with their place (from 0) in order of a column that is unique; no task holds more than a part of the order."""
    own = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "places")
    # such a number is the part's number and the place within it
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return own.withColumn("_part", part).join(before, "_part").withColumn("place", (F.col("_before") + inside).cast("long")).drop("_part", "_before", "_at")


def sample_by_generator(spark: SparkSession, rows: DataFrame, target: int, seed: int, order: str) -> DataFrame:
    """``target`` rows as ``random.Random(seed).sample`` draws them from the rows in order, with position from 0.

    The draw depends on the number of rows only, so the driver draws places, and rows are joined by place.
    ``rows`` are made once, however long that takes, and counted and put in order as written.
    """
    rows = cut(rows, "drawn-from")
    have = rows.count()
    if have < target:
        raise ShortageError(target, have)
    taken = random.Random(seed).sample(range(have), target)  # noqa: S311
    drawn = spark.createDataFrame([(p, k) for k, p in enumerate(taken)], "place long, position int")
    return places(rows, order).join(drawn, "place").drop("place")


def require(rows: DataFrame, target: int) -> DataFrame:
    have = rows.limit(target).count()
    if have < target:
        raise ShortageError(target, have)
    return rows


def stable_id(corpus: str, position: Column) -> Column:
    return F.format_string(f"{corpus}-%05d", position)


def rank_by_hash(rows: DataFrame, draw: Column, tie: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with rank (from 0) in order of the hexadecimal ``draw`` and then ``tie``, and total, within each group.

    Hashes spread evenly over their first three digits, so rows are ranked in 4,096 parts a group and the
    parts are put one after the other by their counts; no task ranks a whole group.
    """
    by = by or []
    own = rows.withColumn("_draw", draw).withColumn("_part", F.substring("_draw", 1, 3))
    counts = own.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    upto, all_ = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)
    first = counts.select(*by, "_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_first"), F.sum("_n").over(all_).alias("total"))
    inside = Window.partitionBy(*by, "_part").orderBy("_draw", tie)
    placed = own.withColumn("_at", F.row_number().over(inside) - 1).join(first, [*by, "_part"])
    return placed.withColumn("rank", F.col("_first") + F.col("_at")).drop("_draw", "_part", "_at", "_first")


def half_split_by_hash(ids: DataFrame, seed: int, key: str = "pair_id", by: list[str] | None = None) -> DataFrame:
    """(by..., key, half, place): equal halves in order of hash; with an odd number the last row is dropped (half null).

    With ``by`` each group is split on its own, by the group's first column for a seed.
    """
    by = by or []
    start = F.lit(str(seed)) if not by else F.col(by[0]).cast("string")
    ranked = rank_by_hash(ids.select(*by, key), F.md5(F.concat(start, F.lit(":"), F.col(key)).cast("binary")), key, by)
    half = F.floor(F.col("total") / 2)
    side = F.when(F.col("rank") < half, "a").when(F.col("rank") < 2 * half, "b")
    return ranked.select(*by, key, side.alias("half"), F.when(side == "b", F.col("rank") - half).otherwise(F.col("rank")).cast("int").alias("place"))


def half_split_by_generator(rows: DataFrame, seed: int, key: str = "pair_id") -> tuple[DataFrame, str | None]:
    """((key, half, place), the dropped key) after ``random.Random(seed).shuffle`` of the keys in order; under four keys is an error.

    The shuffle depends on the number of keys only, so the driver shuffles places, and keys, which are
    unique, are joined by place.
    """
    own = places(rows.select(key), key)
    n = own.count()
    if n < 4:
        raise ValueError(f"a split needs four pairs, not {n}")
    mixed = list(range(n))
    random.Random(seed).shuffle(mixed)  # noqa: S311
    odd = mixed.pop() if n % 2 else None
    half = len(mixed) // 2
    at = rows.sparkSession.createDataFrame([(p, "a" if k < half else "b", k % half) for k, p in enumerate(mixed)], "place long, half string, _at int")
    split = own.join(at, "place").select(key, "half", F.col("_at").alias("place"))
    return split, None if odd is None else own.where(F.col("place") == odd).first()[key]


def split_pairs(split: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, model_text, human_text): place i of one half beside place i of the other, named sc-i."""
    own = split.where("half is not null").join(texts, "pair_id")
    a = own.where("half = 'a'").select("place", F.col("text").alias("model_text"))
    b = own.where("half = 'b'").select("place", F.col("text").alias("human_text"))
    return a.join(b, "place").select(F.format_string("sc-%d", "place").alias("pair_id"), "model_text", "human_text")
