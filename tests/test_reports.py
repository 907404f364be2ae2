import json

import pytest
from pyspark.sql import functions as F

from driftline import cli
from driftline.operators import seams
from driftline.plans import reports as rp
from driftline.plans import scoring
from driftline.sources import records
from driftline.streaming import incremental


def report(name, mmd, l2, jmq, corpus="web", **more):
    j = {} if jmq is None else {"overall": {"score": jmq, "win_rate": jmq / 2, "wins": 1, "losses": 1, "invalid": 0, "n": 2}}
    return {"report_id": name, "compared": {"candidate_set": name, "reference_set": "r", "n": 40} | ({"corpus": corpus} if corpus else {}) | more, "config": {}, "mmd": mmd, "token_l2": l2, "jmq": j, "caveats": [], "schema_version": 1}


def test_deltas(spark):
    c = scoring.compared(spark, report("d", 0.10, 0.010, 0.80), [report("r", 0.04, 0.006, 0.95)], "c")
    d = c["rewrites"][0]["deltas"]
    assert d["mmd"]["delta"] == pytest.approx(-0.06) and d["token_l2"]["delta"] == pytest.approx(-0.004) and d["jmq"]["delta"] == pytest.approx(0.15)
    assert all(x["status"] == "improved" and x["improved"] for x in d.values())
    c = scoring.compared(spark, report("d", 0.1, None, 0.8), [report("r", 0.1, 0.2, 0.7)], "c")
    d = c["rewrites"][0]["deltas"]
    assert (d["mmd"]["status"], d["mmd"]["improved"]) == ("unchanged", None)
    assert d["token_l2"]["delta"] is None and not d["token_l2"]["comparable"] and d["token_l2"]["status"] is None
    assert (d["jmq"]["status"], d["jmq"]["improved"]) == ("regressed", False)
    assert "regressed" in rp.comparison_document(c) and "not comparable" in rp.comparison_document(c)


def test_trajectory_is_by_round(spark):
    rws = [report("k3", 3.0, 0.1, None, round=3), report("none", 0.0, 0.1, None), report("k1", 1.0, 0.1, None, round=1)]
    c = scoring.compared(spark, report("d", 0.1, 0.1, None), rws, "c")
    assert [t["report_id"] for t in c["trajectory"]] == ["k1", "k3", "none"]
    assert c["rewrites"][0]["jmq"] is None


def test_published_rows_are_refused_beside_unconfirmed_reports(spark):
    ok = scoring.compared(spark, report("d", 0.1, 0.1, 1.0), [report("r", 0.1, 0.1, 1.0)], "c", True)
    assert len(ok["benchmark"]["rows"]) == 4 and "0.037" in rp.comparison_document(ok)
    for corpus, name in (("personal", "x"), (None, "x"), (None, "personal-7")):
        with pytest.raises(rp.BenchmarkRefused):
            scoring.compared(spark, report("d", 0.1, 0.1, 1.0), [report(name, 0.1, 0.1, 1.0, corpus)], "c", True)


def test_bounds_and_window():
    assert rp.fair_window(25) == pytest.approx((0.2, 0.8)) and rp.fair_window(1) == (0.0, 1.0)
    with pytest.raises(ValueError, match="comparisons"):
        rp.fair_window(0)
    assert rp.violations(0.0, 0.05, 0.5, 25) == []
    assert len(rp.violations(float("nan"), 0.2, None, 0)) == 3
    assert rp.violations(-0.5, 0.0, 0.5, 25)[0].startswith("mmd -0.5 is under")
    assert rp.violations(0.06, 0.0, None, None, rp.REAL_EMBEDDER, True) and not rp.violations(0.06, 0.0, None, None, "stub", True)


def test_costs():
    assert rp.gate(rp.estimate(2000, rp.CALL_COST), False)["estimated_usd"] == 1.0
    with pytest.raises(rp.CostError):
        rp.gate(rp.estimate(334 * 6, rp.CALL_COST), False)
    rp.gate(rp.estimate(333 * 6, rp.CALL_COST), False)
    with pytest.raises(rp.CostError):
        rp.gate(rp.estimate(101, rp.TEXT_COST), False)
    rp.gate(rp.estimate(101, rp.TEXT_COST), True)


def test_metric_names():
    assert scoring.selected("jmq, mmd") == ("mmd", "jmq")
    for bad in ("", "bleu"):
        with pytest.raises(ValueError, match="metrics"):
            scoring.selected(bad)


def many(spark, n, corpus="web"):
    return spark.createDataFrame([(f"{corpus}-{k:05d}", f"subject {k % 5} verb {k % 3} " + "filler " * (k % 9 + 4)) for k in range(n)], "pair_id string, text string")


def fair():
    import hashlib

    return lambda prompt, model: "AB"[hashlib.md5(prompt.encode()).digest()[0] % 2]


TEMPLATES = {d: d + ": {prompt} {candidate_a} {candidate_b}" for d in records.DIMENSIONS}


def test_self_check(spark, tmp_path):
    ok = scoring.self_check(many(spark, 51), judge=fair, templates=TEMPLATES, verdicts_path=f"{tmp_path}/v")
    assert ok["half_size"] == 25 and ok["dropped_pair_id"] and ok["jmq_n"] == 25
    broken = scoring.self_check(many(spark, 50), judge=lambda: lambda p, m: "neither", templates=TEMPLATES, verdicts_path=f"{tmp_path}/w")
    assert any("no valid verdict" in v for v in broken["violations"])
    alone = scoring.self_check(many(spark, 50), skip_judge=True)
    assert alone["jmq_n"] is None and alone["report"]["caveats"][0]["kind"] == "small_n"


# --- commands


def run(spark, capsys, *argv, clients=None):
    code = cli.main(list(argv), clients, spark)
    out = capsys.readouterr()
    return code, json.loads(out.out) if out.out else None, out.err


ALL = {"prompter": seams.stub_prompter, "drafter": seams.stub_drafter, "rewriter": seams.stub_rewriter, "judge": fair, "detector": seams.stub_detector, "templates": TEMPLATES}


def test_the_whole_way(spark, capsys, tmp_path, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("topic "), F.col("id"), F.repeat(F.lit(" plain words here"), 60)).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/docs")
    code, out, _ = run(spark, capsys, "build-corpus", "--source", f"{tmp_path}/docs", "--out", f"{tmp_path}/corpus", clients=ALL)
    assert code == 0 and out["pairs"] == 50
    reference = out["manifest"]
    code, again, _ = run(spark, capsys, "build-corpus", "--source", f"{tmp_path}/docs", "--out", f"{tmp_path}/corpus", clients=ALL)
    assert code == 0 and again["pairs"] == 50
    assert spark.read.parquet(f"{tmp_path}/corpus/fineweb/pairs").count() == 50
    code, out, _ = run(spark, capsys, "generate", "--corpus", f"{tmp_path}/corpus/fineweb/pairs", "--out", f"{tmp_path}/run", clients=ALL)
    assert (code, out["generated"]) == (0, 50)
    draft = out["manifest"]
    assert run(spark, capsys, "generate", "--corpus", f"{tmp_path}/corpus/fineweb/pairs", "--out", f"{tmp_path}/run", clients=ALL)[1]["already_done"] == 50
    code, out, _ = run(spark, capsys, "rewrite", "--run", f"{tmp_path}/run", "--rounds", "2", "--out", f"{tmp_path}/rw", clients=ALL)
    assert code == 0 and len(out["sets"]) == 2
    common = ["--reference", reference, "--prompts", f"{tmp_path}/corpus/fineweb/pairs"]
    code, d, _ = run(spark, capsys, "score", "--candidate", draft, *common, "--out", f"{tmp_path}/s/draft.json", clients=ALL)
    assert code == 0 and d["compared"]["n"] == 50 and d["jmq"]["overall"]["n"] == 50 and (tmp_path / "s/draft.md").exists()
    code, again, _ = run(spark, capsys, "score", "--candidate", draft, *common, "--recompute-jmq-from", f"{tmp_path}/s/verdicts.jsonl")
    assert code == 0 and again["jmq"] == d["jmq"] and again["mmd"] is None
    code, r, _ = run(spark, capsys, "score", "--candidate", out["sets"][1], *common, "--metrics", "mmd,token_l2", "--out", f"{tmp_path}/s/k2.json")
    assert code == 0 and r["jmq"] == {} and r["compared"]["round"] == 2
    code, c, _ = run(spark, capsys, "report", "--draft-report", f"{tmp_path}/s/draft.json", "--rewrite-report", f"{tmp_path}/s/k2.json", "--benchmark", "--out", f"{tmp_path}/s/c.json")
    assert code == 0 and c["rewrites"][0]["deltas"]["jmq"]["comparable"] is False
    code, s, _ = run(spark, capsys, "self-check", "--reference", reference, "--skip-jmq")
    assert code in (0, 4) and s["half_size"] == 25
    monkeypatch.delenv("PANGRAM_API_KEY", raising=False)
    assert run(spark, capsys, "detect", "--sets", "missing.json", clients=ALL)[0] == 3
    monkeypatch.setenv("PANGRAM_API_KEY", "x")
    code, out, _ = run(spark, capsys, "detect", "--sets", draft, out["sets"][0] if "sets" in out else reference, "--out", f"{tmp_path}/s/det.json", clients=ALL)
    assert code == 0 and out["sc005"]["delta"] is not None and (tmp_path / "s/det.scores.jsonl").exists()
    assert run(spark, capsys, "detect", "--sets", draft, reference, "--out", f"{tmp_path}/s/det2.json", clients=ALL)[0] == 6
    assert run(spark, capsys, "detect", "--sets", draft, reference, draft, "--out", f"{tmp_path}/s/det3.json", clients=ALL)[0] == 2
    assert run(spark, capsys, "detect", "--sets", draft, "--out", "x.txt", clients=ALL)[0] == 2


def test_codes_of_bad_calls(spark, capsys, tmp_path):
    assert cli.main([], None, spark) == 2
    assert run(spark, capsys, "score", "--candidate", "none.json", "--reference", "none.json")[0] == 2
    assert run(spark, capsys, "score", "--candidate", "c", "--reference", "r", "--recompute-jmq-from", f"{tmp_path}/no")[0] == 3
    assert run(spark, capsys, "generate", "--corpus", f"{tmp_path}/no")[0] == 3
    assert run(spark, capsys, "rewrite", "--run", "x", "--rounds", "9", clients=ALL)[0] == 2
    assert run(spark, capsys, "rewrite", clients=ALL)[0] == 2
    assert run(spark, capsys, "report", "--draft-report", "no.json", "--rewrite-report", "no.json")[0] == 2


# --- streams


def test_append_new_goes_on_where_it_stopped(spark, tmp_path):
    df = many(spark, 6)
    go = lambda: incremental.append_new(incremental.documents(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/sink", f"{tmp_path}/state", step=lambda x: x.withColumn("n", F.char_length("text")))
    df.limit(2).write.parquet(f"{tmp_path}/in")
    assert go() == 2
    df.write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == 4 and go() == 0
    sink = spark.read.parquet(f"{tmp_path}/sink")
    assert sink.count() == 6 and "n" in sink.columns
    row = incremental.progress(spark, f"{tmp_path}/sink", sink.schema, many(spark, 8)).first()
    assert (row["planned"], row["done"], row["left"]) == (8, 6, 2)
