import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import text as tx
from driftline.operators import cascade, detection, judging, sampling, seams, setops
from driftline.sources.records import DIMENSIONS


def texts(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, text string")


# --- sets


def test_pairing_gates(spark):
    a = texts(spark, [("p1", "x"), ("p2", "y")])
    assert setops.check_pairing(a, a) == 2
    for other, gate in ((texts(spark, [("p1", "x")]), "count"), (texts(spark, [("p1", "x"), ("p3", "y")]), "p3"), (texts(spark, [("p1", " "), ("p2", "y")]), "length")):
        with pytest.raises(setops.SetError, match=gate):
            setops.check_pairing(a, other)
    with pytest.raises(setops.SetError, match="min_n"):
        setops.check_pairing(a.limit(1), a.limit(1))
    assert setops.check_pairing(a.limit(1), a.limit(1), allow_small=True) == 1


def test_alignment_and_resume(spark):
    a, b = texts(spark, [("p1", "x"), ("p2", "y")]), texts(spark, [("p2", "z"), ("p3", "w")])
    c, r = setops.align_common(a, b)
    assert [x["pair_id"] for x in c.collect()] == ["p2"] and [x["text"] for x in r.collect()] == ["z"]
    assert [x["pair_id"] for x in setops.remaining(a, b).collect()] == ["p1"]
    assert [x["pair_id"] for x in setops.strays(b, a).collect()] == ["p3"]
    assert setops.overlap(a, b).count() == 1


def test_cache(spark):
    t = texts(spark, [("p1", "x"), ("p2", "x"), ("p3", "y")])
    cache = spark.createDataFrame([("e", setops.F.lit, [1.0])][:0], "embedder_id string, content_sha256 string, vector array<double>")
    assert setops.cache_misses(t, cache, "e").count() == 2
    sound = spark.createDataFrame([("e", "h1", [1.0]), ("e", "h2", [2.0]), ("f", "h1", [1.0]), ("f", "h1", [1.0, float("nan")])], cache.schema)
    got = {r["embedder_id"]: r for r in setops.cache_audit(sound).collect()}
    assert (got["e"]["twice"], got["e"]["dim_spread"], got["e"]["not_finite"]) == (0, 0, 0)
    assert (got["f"]["twice"], got["f"]["dim_spread"], got["f"]["not_finite"]) == (1, 1, 1)


def test_cache_embeds_each_content_once(spark, tmp_path):
    from driftline.operators import cache

    t = texts(spark, [("p1", "x"), ("p2", "x"), ("p3", "y")])
    path = f"{tmp_path}/cache"
    assert cache.validate(cache.read(spark, path), "e") is None
    got = {r["pair_id"]: r["vector"] for r in cache.embed(t, path, "e", seams.stub_embedder).collect()}
    assert got["p1"] == got["p2"] != got["p3"] and cache.read(spark, path).count() == 2
    again = {r["pair_id"]: r["vector"] for r in cache.embed(t, path, "e", seams.no_embedder).collect()}
    assert again == got
    with pytest.raises(Exception, match="not in the cache"):
        cache.embed(texts(spark, [("p4", "new")]), path, "e", seams.no_embedder).collect()
    assert cache.embed(t, path, "other", seams.stub_embedder).count() == 3
    spark.createDataFrame([("h", [1.0], "e")], cache.SCHEMA).write.mode("append").partitionBy("embedder_id").parquet(path)
    with pytest.raises(cache.CacheError, match="dim_spread"):
        cache.embed(t, path, "e", seams.stub_embedder)


def test_mean_pooling():
    import numpy as np

    h = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]])
    assert seams.mean_pooled(h, np.array([[1, 1, 0], [0, 0, 0]])).tolist() == [[2.0, 3.0], [0.0, 0.0]]


# --- sampling


def test_pool_caps():
    assert [sampling.pool_cap(n) for n in (50, 2000)] == [500, 20000]


def test_generator_sample_is_the_sequential_one(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    got = {r["position"]: r["doc_id"] for r in sampling.sample_by_generator(spark, df, 10, 4, "doc_id").collect()}
    assert [got[k] for k in range(10)] == random.Random(4).sample(range(100), 10)
    with pytest.raises(sampling.ShortageError) as e:
        sampling.sample_by_generator(spark, df, 101, 4, "doc_id")
    assert (e.value.requested, e.value.available) == (101, 100)


def test_hash_sample_is_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    a, b = (sorted(map(tuple, sampling.sample_by_hash(x, 7, 1, "doc_id").collect())) for x in (df, df.repartition(5)))
    assert a == b and len(a) == 7


@pytest.mark.parametrize("n", [4, 7])
def test_half_splits(spark, n):
    ids = [f"p{k}" for k in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "pair_id string")
    rows = sampling.half_split_by_hash(df, 3).collect()
    halves = {h: {r["pair_id"] for r in rows if r["half"] == h} for h in ("a", "b")}
    assert len(halves["a"]) == len(halves["b"]) == n // 2 and not halves["a"] & halves["b"]
    split, dropped = sampling.half_split_by_generator(df.repartition(3), 3)
    mixed = sorted(ids)
    random.Random(3).shuffle(mixed)
    assert dropped == (mixed.pop() if n % 2 else None)
    want = {(p, "a" if k < n // 2 else "b", k % (n // 2)) for k, p in enumerate(mixed)}
    assert {(r["pair_id"], r["half"], r["place"]) for r in split.collect()} == want
    with pytest.raises(ValueError, match="four"):
        sampling.half_split_by_generator(df.limit(3), 0)


def test_qualification(spark):
    body = "word " * 200
    rows = [(1, body, "en"), (2, "short", "en"), (3, body, "de"), (4, body, None), (5, "é" * 400 + body, None), (6, "subscribe\n" + body, "en"), (7, None, "en"), (8, "word " * 150, "en"), (9, "word " * 1201, "en")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert sorted(r["doc_id"] for r in sampling.qualified(df).collect()) == [1, 4, 8]


# --- judging


def verdict(spark, rows):
    return spark.createDataFrame([(p, d, "j", o, "", c, 0, w) for p, d, o, c, w in rows], "pair_id string, dimension string, judge_model string, order string, raw_response string, choice string, retry_count int, model_won boolean")


def test_scores(spark):
    v = verdict(spark, [("a", "overall", "model_first", "A", True), ("b", "overall", "model_first", "A", True), ("c", "overall", "human_first", "B", True), ("d", "overall", "model_first", "B", False), ("e", "overall", "model_first", "invalid", None)])
    got = {r["dimension"]: r for r in judging.scores(v).collect()}
    o = got["overall"]
    assert (o["wins"], o["losses"], o["invalid"], o["n"], o["win_rate"], o["score"]) == (3, 1, 1, 4, 0.75, 1.5)
    assert set(got) == set(DIMENSIONS) and got["depth"]["score"] is None and got["depth"]["n"] == 0
    shuffled = {r["dimension"]: tuple(r) for r in judging.scores(v.repartition(3)).collect()}
    assert shuffled == {k: tuple(x) for k, x in got.items()}
    audit = judging.order_audit(v).first()
    assert (audit["pairs"], audit["model_first"], audit["model_first_fraction"]) == (5, 4, 0.8)
    assert judging.judge_of(v).first()["judge_model"] == "j"


def flaky():
    seen = {}

    def ask(prompt, model):
        seen[prompt] = seen.get(prompt, 0) + 1
        if "fail" in prompt:
            raise TimeoutError("late")
        return "mumble" if "retry" in prompt and seen[prompt] == 1 else "A."

    return ask


def test_judge_calls_never_raise(spark):
    rows = [("p1", "overall", "model_first", "fine"), ("p2", "overall", "human_first", "retry"), ("p3", "overall", "model_first", "fail")]
    df = spark.createDataFrame(rows, "pair_id string, dimension string, order string, rendered string")
    got = {r["pair_id"]: r for r in judging.judged(df, flaky, pause=0.0).collect()}
    assert (got["p1"]["choice"], got["p1"]["model_won"], got["p1"]["retry_count"]) == ("A", True, 0)
    assert (got["p2"]["model_won"], got["p2"]["retry_count"]) == (False, 1)
    assert got["p3"]["choice"] == "invalid" and got["p3"]["raw_response"].startswith("[judge-call-failed]") and got["p3"]["model_won"] is None


# --- detectors


def test_detector_summary(spark):
    df = spark.createDataFrame([("s", v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)] + [("t", v) for v in (0.1, 0.2, 0.6, 0.9)] + [("u", 0.3)], "set_id string, human_prob double")
    got = {r["set_id"]: r for r in detection.summary(df, ["set_id"]).collect()}
    assert (got["s"]["mean"], got["s"]["median"]) == (0.5, 0.5) and got["s"]["stdev"] == pytest.approx(0.125**0.5)
    assert got["t"]["median"] == pytest.approx(0.4) and got["t"]["mean"] == pytest.approx(0.45)
    assert got["u"]["stdev"] == 0.0 and got["u"]["p90"] == 0.3


@pytest.mark.parametrize("accuracy", [detection.ACCURACY, 40])
def test_quantiles_with_outliers_infinities_ties_and_nulls(spark, accuracy):
    import numpy as np

    r = np.random.default_rng(2)
    groups = {
        "even": r.random(4001), "outlier": np.append(r.random(3000), 1e12), "both": np.append(r.random(500), [np.inf, -np.inf]), "tied": np.append(np.full(5000, 3.25), r.random(1000)), "two": np.array([1.0, 2.0]),
        "steps": r.integers(0, 5, 2000).astype(float), None: r.normal(size=777), "same": np.full(50, np.inf),
    }
    rows = [(g, float(x)) for g, x in ((g, x) for g, v in groups.items() for x in v)] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {x["g"]: x["q"] for x in detection.quantiles(df, ["g"], "v", shares, accuracy).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v = np.sort(v)
        place = [(len(v) - 1) * p for p in shares]
        want = [v[int(x)] if v[int(x)] == v[math.ceil(x)] else v[int(x)] + (x - int(x)) * (v[math.ceil(x)] - v[int(x)]) for x in place]
        assert got[g] == pytest.approx(want, rel=1e-12)
    alone = detection.quantiles(df.where("g = 'outlier'"), [], "v", (0.5,), accuracy).first()["q"]
    assert alone == pytest.approx([got["outlier"][2]])


def test_no_task_orders_more_than_a_bracket(spark):
    """One value far off, which even bins between the extremes would give one bin with all others in it."""
    df = spark.range(50_000).select((F.col("id") / 50_000).alias("v")).unionByName(spark.createDataFrame([(1e12,)], "v double"))
    assert detection.quantiles(df, [], "v", (0.5,), 1000).first()["q"] == [0.5]
    width = detection.ERRORS / 1000
    ends = df.agg(F.percentile_approx("v", F.array(F.lit(0.5 - width), F.lit(0.5 + width)), 1000)).first()[0]
    assert df.where(F.col("v").between(*ends)).count() <= 50_000 * 2 * 1.25 * width


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.5, 0.95, 1.0)], "human_prob double")
    got = {r["bin"]: r["n"] for r in detection.histogram(df, []).collect()}
    assert got == {k: {0: 2, 5: 1, 9: 2}.get(k, 0) for k in range(10)}


def test_rise_needs_one_set_of_each(spark):
    rows = [("d", "instruct_draft", 0.1), ("r", "rewrite", 0.4), ("h", "human_reference", 0.9)]
    df = spark.createDataFrame(rows, "set_id string, role string, mean double")
    r = detection.rise(df).first()
    assert r["delta"] == pytest.approx(0.3) and r["passed"] == (0.4 - 0.1 >= 0.3)
    assert detection.rise(df.where("role <> 'rewrite'")).first()["delta"] is None
    assert detection.rise(df.unionByName(df.where("role = 'rewrite'"))).first()["passed"] is None


def test_a_failed_detector_call_fails_the_set(spark):
    df = spark.createDataFrame([("s", "rewrite", "p", "x")], "set_id string, role string, pair_id string, text string")
    with pytest.raises(Exception, match="no probability"):
        detection.scored(df, lambda: lambda t: 1.5).collect()


# --- cascade


ROUNDS = [
    ("p1", 0, "one two three four"), ("p1", 1, "one two three five"), ("p1", 2, "x"), ("p1", 3, "one two three six"),
    ("p2", 0, "alpha beta gamma"), ("p2", 1, "alpha beta delta"), ("p2", 2, "alpha beta omega"),
    ("p3", 0, "only a draft"), ("p4", 0, "a draft text"), ("p4", 1, "é" * 12),
]


def test_stored_rounds(spark):
    df = spark.createDataFrame(ROUNDS, "pair_id string, k int, text string")
    got = {r["pair_id"]: (r["executed"], r["final_round"], r["hard_tripped"], r["flags"]) for r in cascade.outcomes(df, 3).collect()}
    assert got == {"p1": (2, 1, True, "length_ratio"), "p2": (2, 2, False, ""), "p3": (0, 0, False, ""), "p4": (1, 0, True, "non_ascii_burst")}
    assert all(r["final_round"] <= 1 for r in cascade.outcomes(df, 1).collect())
    sets = sorted((r["k"], r["pair_id"]) for r in cascade.round_sets(df, 3).collect())
    assert sets == [(1, "p1"), (1, "p2"), (2, "p2")]
    s = cascade.run_summary(df, 3, df.where("pair_id = 'p2'")).first()
    assert (s["pairs"], s["already_done"], s["rewritten"], s["flagged_degenerate"]) == (4, 1, 3, 2)


def breaking():
    return lambda text, k: "" if text.startswith("blank") else "x" if text.startswith("short") and k == 2 else f"{text} [r{k}]"


def test_live_rounds_stop_at_a_trip_and_match_the_stored_form(spark, tmp_path):
    drafts = texts(spark, [("p1", "short but good enough to go on"), ("p2", "another text that stays fine")])

    def save(df, k):
        df.write.parquet(f"{tmp_path}/k{k}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/k{k}")

    out = cascade.run(drafts, breaking, 3, save)
    assert sorted((r["pair_id"], r["k"]) for r in out.collect()) == [("p1", 0), ("p1", 1), ("p1", 2), ("p2", 0), ("p2", 1), ("p2", 2), ("p2", 3)]
    stored = {r["pair_id"]: r["final_round"] for r in cascade.outcomes(out.select("pair_id", "k", "text"), 3).collect()}
    assert stored == {"p1": 1, "p2": 3}
    b = {r["pair_id"]: r for r in cascade.bundles(out.select("pair_id", "k", "text"), drafts.withColumn("prompt", F.lit("q")), "run", "ad", {"temperature": "1.0"}, 3, "m").collect()}
    assert len(b["p1"]["rounds"]) == 2 and b["p1"]["degeneration"]["hard_tripped"] and b["p2"]["config"]["seed_applied"] == "false"


def test_a_blank_rewrite_is_an_error(spark):
    with pytest.raises(Exception, match="no text"):
        cascade.rewritten(texts(spark, [("p1", "blank")]), breaking, 1).collect()
    for k in (0, 5):
        with pytest.raises(ValueError, match="rounds"):
            cascade.check_rounds(k)


def test_drafts_resume_with_their_own_seeds(spark):
    prompts = spark.createDataFrame([("p1", "q1"), ("p2", "q2")], "pair_id string, prompt string")
    done = texts(spark, [("p1", "old")])
    got = cascade.generated(prompts, done, seams.stub_drafter, 5).collect()
    assert [r["pair_id"] for r in got] == ["p2"]
    again = cascade.generated(prompts, done, seams.stub_drafter, 5).collect()
    assert got == again
    with pytest.raises(Exception, match="no draft"):
        cascade.generated(prompts, done, lambda: lambda *a: " ", 5).collect()


def test_qualification_counts_words_once_and_last_of_the_cheap_checks(spark):
    """Filters that repeat an expression work it out as often; here it once was twice in the filter, for texts of any label."""
    rows = [(k, " ".join(["word"] * n), lang) for k, (n, lang) in enumerate([(149, "en"), (150, "en"), (1200, None), (1201, "en"), (300, "de"), (300, None)])]
    rows += [(10, " ".join(["w"] * 150), "en"), (11, " ".join(["w"] * 149), "en"), (12, None, "en"), (13, "　" * 400, None)]
    own = sampling.qualified(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert {(r["doc_id"], r["word_count"]) for r in own.collect()} == {(1, 150), (2, 1200), (5, 300), (10, 150)}
    plan = own.select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    counted = f"[^{tx.SPACE}]+"
    assert plan.count(counted) == 1 and plan.index("= en)") < plan.index(counted)


def test_a_generator_sample_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    rows = spark.range(40).mapInPandas(count, "id long")
    got = sampling.sample_by_generator(spark, rows, 5, 3, "id").collect()
    assert {r["id"]: r["position"] for r in got} == {k: p for p, k in enumerate(random.Random(3).sample(range(40), 5))}
    assert made.value == 40
