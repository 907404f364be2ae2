"""Gates and joins of text sets by pair id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import strip


class SetError(ValueError):
    """Two text sets that don't belong together, or a set that can't be scored."""


def id_difference(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, side) of ids on one side only."""
    left = a.select(key).distinct().withColumn("l", F.lit(True))
    right = b.select(key).distinct().withColumn("r", F.lit(True))
    both = left.join(right, key, "full_outer").where("l is null or r is null")
    return both.select(key, F.when(F.col("r").isNull(), "candidate").otherwise("reference").alias("side"))


def pairing_gate(candidate: DataFrame, reference: DataFrame, min_n: int = 2, min_length: int = 1, key: str = "pair_id") -> DataFrame:
    """One row: sizes, ids on one side only, texts under the least length on either side, and the first gate that fails (null: none)."""
    short = lambda df: df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.char_length(strip("text")) < min_length, F.lit(True))).alias("short"))
    c = short(candidate).select(F.col("n").alias("n_candidate"), F.col("short").alias("short_candidate"))
    r = short(reference).select(F.col("n").alias("n_reference"), F.col("short").alias("short_reference"))
    d = id_difference(candidate, reference, key).agg(
        F.count_if(F.col("side") == "candidate").alias("only_candidate"), F.count_if(F.col("side") == "reference").alias("only_reference")
    )
    # three one-row frames
    one = c.join(r).join(d)
    failed = (
        F.when(F.col("n_candidate") != F.col("n_reference"), "count").when((F.col("only_candidate") > 0) | (F.col("only_reference") > 0), "pairing")
        .when(F.col("n_candidate") < min_n, "min_n").when((F.col("short_candidate") > 0) | (F.col("short_reference") > 0), "length")
    )
    return one.withColumn("failed", failed)


def check_pairing(candidate: DataFrame, reference: DataFrame, min_n: int = 2, min_length: int = 1, allow_small: bool = False) -> int:
    """Number of pairs; raises what the first failing gate says."""
    row = pairing_gate(candidate, reference, 0 if allow_small else min_n, min_length).first()
    if row["failed"] == "pairing":
        some = id_difference(candidate, reference).orderBy("side", "pair_id").limit(10).collect()
        raise SetError("ids on one side only: " + ", ".join(f"{r['pair_id']} ({r['side']})" for r in some))
    if row["failed"]:
        raise SetError(f"{row['failed']}: {row.asDict()}")
    return row["n_candidate"]


def align_common(candidate: DataFrame, reference: DataFrame, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """Both sets cut down to the ids they share."""
    return candidate.join(reference, key, "left_semi"), reference.join(candidate, key, "left_semi")


def remaining(planned: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """What is planned and not yet done."""
    return planned.join(done, key, "left_anti")


def strays(done: DataFrame, planned: DataFrame, key: str = "pair_id") -> DataFrame:
    """What is done and not in the plan; any row means that the corpus has changed under a run."""
    return done.join(planned, key, "left_anti")


def joined_pairs(candidate: DataFrame, reference: DataFrame, prompts: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair_id, prompt, model_text, human_text)."""
    c = candidate.select(key, F.col("text").alias("model_text"))
    r = reference.select(key, F.col("text").alias("human_text"))
    return c.join(r, key).join(prompts.select(key, "prompt"), key).select(key, "prompt", "model_text", "human_text")


def overlap(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """Ids in both; two halves of a set have none."""
    return a.select(key).intersect(b.select(key))


def cache_misses(texts: DataFrame, cache: DataFrame, embedder_id: str) -> DataFrame:
    """(content_sha256, text) to embed: each content once, unless the cache has it for this embedder; a null text has no content."""
    from driftline.functions.text import content_sha256

    wanted = texts.where("text is not null").select(content_sha256("text").alias("content_sha256"), "text").dropDuplicates(["content_sha256"])
    return wanted.join(cache.where(F.col("embedder_id") == embedder_id), "content_sha256", "left_anti")


def cache_audit(cache: DataFrame) -> DataFrame:
    """(embedder_id, entries, twice, dims, not_finite) a store; sound ones have no entry twice, one dimension and finite numbers."""
    own = cache.withColumn("dim", F.size("vector")).withColumn("odd", F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    keyed = own.groupBy("embedder_id", "content_sha256").agg(F.count("*").alias("n"), F.min("dim").alias("lo"), F.max("dim").alias("hi"), F.count_if("odd").alias("odd"))
    return keyed.groupBy("embedder_id").agg(
        F.sum("n").alias("entries"), F.count_if(F.col("n") > 1).alias("twice"), (F.max("hi") - F.min("lo")).alias("dim_spread"), F.sum("odd").alias("not_finite")
    )
