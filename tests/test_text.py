import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import text as tx


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def many(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


TEXTS = ["", " ", "a b", " a\tb\nc ", "x y", "a b\x1cc", "ä" * 3 + "b" * 7, "no words .. here", "Cookie\nplain\n\nSubscribe now", "日本 語"]


def test_words_and_strip_follow_python(spark):
    assert many(spark, tx.word_count("t"), TEXTS) == [len(re.findall(r"\S+", t)) for t in TEXTS]
    assert many(spark, tx.strip("t"), TEXTS) == [t.strip() for t in TEXTS]


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_words_follow_python_on_any_text(spark, data):
    texts = data.draw(st.lists(st.text(st.sampled_from("ab .\t\n\r\x0b\x0c\x1c\x85  　é!?'"), max_size=40), min_size=60, max_size=60))
    assert many(spark, tx.word_count("t"), texts) == [len(re.findall(r"\S+", t)) for t in texts]
    assert many(spark, tx.strip("t"), texts) == [t.strip() for t in texts]

    def starts(t):
        return [m[0].lower() for s in re.split(r"(?<=[.!?])\s+", t) if (m := re.search(r"[A-Za-z']+", s))]

    assert many(spark, tx.sentence_starts("t"), texts) == [starts(t) for t in texts]


def test_english_share_includes_its_limit(spark):
    texts = ["é" + "a" * 9, "éé" + "a" * 9, "", "abc"]
    assert many(spark, tx.looks_english("t"), texts) == [True, False, False, True]


def test_boilerplate(spark):
    texts = ["Accept cookies\nprose\nprose\nprose", "Accept cookies\nprose\nprose", "", " \n ", "prose\r\nmore prose"]
    assert many(spark, tx.boilerplate_heavy("t"), texts) == [False, True, True, True, False]
    assert many(spark, tx.boilerplate_fraction("t"), texts)[2] is None


def test_parse_choice(spark):
    texts = ["A", " b ", "A.", "B.\n", "", "The answer is A", "A or B", "A. .", "a..", " B"]
    assert many(spark, tx.parse_choice("t"), texts) == ["A", "B", "A", "B", "invalid", "invalid", "invalid", "invalid", "A", "B"]


@pytest.mark.parametrize(("choice", "order", "won"), [("A", "model_first", True), ("B", "model_first", False), ("A", "human_first", False), ("B", "human_first", True), ("invalid", "model_first", None)])
def test_model_won(spark, choice, order, won):
    assert one(spark, tx.model_won("c", "o"), c=choice, o=order) is won


def test_orders_follow_the_generator(spark):
    ids = [f"web-{k:05d}" for k in range(40)]
    want = ["model_first" if random.Random(f"3:{i}").random() < 0.5 else "human_first" for i in ids]
    assert many(spark, tx.order_by_mersenne("t", 3), ids) == want
    by_hash = many(spark, tx.order_by_hash("t", 3), ids)
    assert set(by_hash) == {"model_first", "human_first"}


def test_render_is_sequential(spark):
    got = one(spark, tx.render_prompt(F.col("t"), F.col("p"), F.lit("AA"), F.lit("BB")), t="{prompt}|{candidate_a}|{candidate_b}", p="see {candidate_b}")
    assert got == "see BB|AA|BB"


DEGENERATE = [
    ("A fine text that is long enough. Another one follows here.", None, False, []),
    ("   \n\t  ", 10, True, ["empty"]),
    ("x" * 300, 100, True, ["length_ratio"]),
    ("x" * 40, 100, True, ["length_ratio"]),
    ("x" * 50, 100, False, []),
    ("x" * 200, 100, False, []),
    ("The a. The b. The c. The d.", None, False, ["repetition"]),
    ("normal " + "éüñç" * 20, None, True, ["non_ascii_burst"]),
]


@pytest.mark.parametrize(("text", "prior", "hard", "flags"), DEGENERATE)
def test_degeneration(spark, text, prior, hard, flags):
    r = one(spark, tx.degeneration("t", F.lit(prior).cast("int")), t=text)
    assert (r["hard_tripped"], r["flags"]) == (hard, flags)
    if flags == ["empty"]:
        assert r["length_ratio"] is None and r["non_ascii_fraction"] == 0.0


def test_longest_run(spark):
    df = spark.createDataFrame([(["a", "a", "b", "b", "b", "a"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(tx.longest_run(F.col("x"))).collect()] == [3, 0]


def test_ids_and_names(spark):
    assert many(spark, tx.corpus_of("t"), ["web-00001", "a-b-2", "plain"]) == ["web", "a-b", "plain"]
    assert many(spark, tx.round_of_artifact("t"), ["rewrite-k2.jsonl", "rewrite-k10.manifest.json", "rewrite-kx", "draft"]) == [2, 10, None, None]
    assert many(spark, tx.slug("t"), ["a/b c", "Größe_1-2"]) == ["a_b_c", "Größe_1-2"]
    assert many(spark, tx.content_sha256("t"), ["hello"])[0].startswith("2cf24dba")


def test_provenance_falls_through_empty_ids(spark):
    df = spark.createDataFrame([("7", "u", 0), ("", "u", 1), (None, "", 2)], "id string, url string, i int")
    assert [r[0]["doc_id"] for r in df.select(tx.provenance("d", "c", F.col("id"), F.col("url"), F.col("i"))).collect()] == ["7", "u", "index-2"]


def test_detector_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(tx.valid_probability("v")).collect()] == [True, True, False, False, False]


def test_formats():
    assert tx.format_number(None) == "not run" and tx.format_number(float("nan")) == "not run" and tx.format_number(0.1234567) == "0.123457"
    assert tx.format_delta(-0.06, "improved") == "-0.06 (improved)" and tx.format_delta(None, None) == "not comparable"
