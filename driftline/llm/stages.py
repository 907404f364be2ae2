"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of documents.

Rows go through whole, so columns of other tables, whatever their names, and rows with null or repeated
keys come out as they went in.  Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm import bpe, langid, minhash, mixing
from driftline.llm.common import cut, unused
from driftline.llm.queries import held_out, tokenizer_path
from driftline.session import ship


def whole(docs: DataFrame):
    """A row's columns as one, so that none is in the way of a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have.

    What has no letter goes, null texts among it, as does a text whose cosine with its language is
    below all that labelled texts of about its length suggest (:func:`langid.limits`).  The scores of
    short texts spread widely, so few of these go.  Repeated rows go or stay together.  Without
    labelled texts nothing is known and everything goes.
    """
    ship(spark)
    model = langid.train(docs.where(~held_out()))
    least = langid.limits(docs.where(~held_out()), *model)
    pred, score = unused("lang_pred", docs.columns), unused("score", docs.columns)
    limit = F.coalesce(F.get(F.array(*[F.lit(x) for x in least]), langid.size_class(F.col("text"))), F.lit(0.0)) if least else F.lit(0.0)
    found = langid.predict(docs, *model, pred=pred, score=score)
    return found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= limit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest doc_id; shingles of five words, similarity 0.8.

    Rows are grouped under keys of their own, so a doc_id may be null or stand for several rows: null
    ones come last in their group, and a hash of the columns decides between rows with one doc_id.  Of
    repeated rows one stays.  A text without words is in no group and stays.
    """
    ship(spark)
    keyed = cut(docs.select(whole(docs), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    groups = minhash.near_duplicates(keyed.select("row", "doc.text"), key="row", width=5, num=80, den=100).select("row", "component_id")
    first = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.xxhash64("doc"), F.col("row"))
    ranked = groups.join(keyed.select("row", first.alias("first")), "row")
    kept = ranked.groupBy("component_id").agg(F.min("first").alias("first")).select("first.row")
    return keyed.join(kept, "row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it doesn't take go, among them texts without words.

    Null is a source of its own.  Rows with equal keys, texts and sources share what the mix takes of them.
    """
    ship(spark)
    keyed = docs.select(whole(docs), F.xxhash64("doc_id", "text", "source").alias("row"))
    times = F.expr("CASE WHEN size > 0 THEN taken DIV size ELSE 0 END")
    taken = mixing.mix(keyed.select("row", "doc.text", "doc.source"), key="row").groupBy("row").agg(F.sum(times).alias("total"), F.count("*").alias("rows"))
    # repeated rows share what the mix takes of them; one shuffle deals both sides by row
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    own = F.floor(F.col("total") / F.col("rows")) + F.when(F.col("nth") <= F.col("total") % F.col("rows"), 1).otherwise(0)
    copies = keyed.withColumn("nth", nth).join(taken.where("total > 0"), "row").withColumn("times", own.cast("int")).where("times > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from its ids and their text; a null text is an empty one."""
    ship(spark)
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
