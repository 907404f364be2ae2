import json
import threading
import time
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftline import cli
from driftline.operators import cascade, judging, progress, seams
from driftline.operators.setops import SetError
from driftline.sources import records
from driftline.streaming import incremental

TEXT = "pair_id string, text string"


def texts(spark, n, corpus="web"):
    return spark.createDataFrame([(f"{corpus}-{k:05d}", f"text number {k} of several words that stay") for k in range(n)], TEXT)


def counting(folder, bad=None):
    """A client's factory that leaves a file a call, and fails on texts that hold ``bad`` as long as a file named fail is there."""

    def factory():
        def call(text, *rest):
            if bad and bad in text and Path(folder, "fail").exists():
                raise ConnectionError("the model went away")
            Path(folder, "calls").mkdir(exist_ok=True)
            Path(folder, "calls", uuid.uuid4().hex).write_text(f"{text.split(' [')[0]}|{rest[0] if rest else ''}")
            return f"{text} [r{rest[0]}]" if rest and isinstance(rest[0], int) else f"A draft for {text}"

        return call

    return factory


def calls(folder):
    return Counter(p.read_text() for p in Path(folder, "calls").glob("*"))


def test_batches_hold_every_row_once(spark):
    own = texts(spark, 25)
    parts = [[r["pair_id"] for r in b.collect()] for b in progress.batches(own, "pair_id", 4)]
    assert len(parts) == 7 and sorted(x for p in parts for x in p) == sorted(r["pair_id"] for r in own.collect())
    assert list(progress.batches(own.limit(0), "pair_id")) == []


def test_a_run_that_fails_keeps_finished_batches_and_calls_no_pair_again(spark, tmp_path):
    own, sink, kind = texts(spark, 24), f"{tmp_path}/sink", "pair_id string, text string, k int"
    factory = counting(str(tmp_path), "number 5 ")
    step = lambda rows: cascade.rewritten(rows, factory, 1).withColumn("k", F.lit(1))
    (tmp_path / "fail").touch()
    with pytest.raises(Exception, match="went away"):
        progress.append(own, sink, kind, step, per_batch=3)
    kept = {r["pair_id"] for r in incremental.have(spark, sink, records.T._parse_datatype_string(kind)).collect()}
    assert 0 < len(kept) < 24 and "web-00005" not in kept
    (tmp_path / "fail").unlink()
    done = progress.append(own, sink, kind, step, per_batch=3)
    assert done == progress.Done(24, len(kept), 24 - len(kept))
    assert spark.read.parquet(sink).groupBy("pair_id").count().where("count > 1").count() == 0 and spark.read.parquet(sink).count() == 24
    again = {f"text number {int(p[-5:])} of several words that stay|1" for p in kept}
    assert all(calls(tmp_path)[c] == 1 for c in again)  # what was finished is not asked for again
    assert progress.append(own, sink, kind, step) == progress.Done(24, 24, 0)
    with pytest.raises(SetError, match="web-00023"):
        progress.append(own.where("pair_id <> 'web-00023'"), sink, kind, step)
    assert progress.append(own.limit(3), sink, kind, step, others=True) == progress.Done(3, 3, 0)
    with pytest.raises(SetError, match="without"):
        progress.append(own.unionByName(spark.createDataFrame([(None, "x")], TEXT)), sink, kind, step)


def run(spark, capsys, *argv, clients):
    code = cli.main(list(argv), clients, spark)
    out = capsys.readouterr()
    return code, json.loads(out.out) if out.out else None, out.err


def test_rewrite_goes_on_where_it_failed(spark, capsys, tmp_path):
    lines = "".join(json.dumps({"pair_id": f"web-{k:05d}", "text": f"text number {k} of several words that stay"}) + "\n" for k in range(12))
    (tmp_path / "drafts.jsonl").write_text(lines)
    clients = {"rewriter": counting(str(tmp_path), "number 7 ")}
    call = ["--batch", "2", "rewrite", "--draft-file", f"{tmp_path}/drafts.jsonl", "--rounds", "2", "--out", f"{tmp_path}/run"]
    (tmp_path / "fail").touch()
    assert run(spark, capsys, *call, clients=clients)[0] == 2
    kept = spark.read.parquet(f"{tmp_path}/run/rounds").select("pair_id").distinct().count()
    (tmp_path / "fail").unlink()
    code, out, _ = run(spark, capsys, *call, clients=clients)
    assert code == 0 and (out["pairs"], out["already_done"], out["rewritten"]) == (12, kept, 12 - kept) and 0 < kept < 12
    assert len(out["sets"]) == 2 and spark.read.parquet(f"{tmp_path}/run/rounds").count() == 24
    once = calls(tmp_path)
    code, out, _ = run(spark, capsys, *call, clients=clients)
    assert (code, out["already_done"], out["rewritten"]) == (0, 12, 0) and calls(tmp_path) == once
    (tmp_path / "drafts.jsonl").write_text(lines.splitlines()[0] + "\n")
    code, _, err = run(spark, capsys, *call, clients=clients)
    assert code == 2 and "the plan lacks" in err


def test_rewrite_of_another_programs_bundles_counts_torn_lines(spark, capsys, tmp_path):
    def bundle(k):
        full = {f.name: None for f in records.schema("bundle")} | {"pair_id": f"web-{k:05d}", "draft": {"text": f"text number {k} of several words"}, "prompt": "q", "schema_version": 1}
        return json.dumps(full)

    (tmp_path / "bundles.jsonl").write_text("\n".join([bundle(0), bundle(1), bundle(0), '{"run_id": "torn'] ))
    code, out, _ = run(spark, capsys, "rewrite", "--run", str(tmp_path), "--rounds", "1", "--out", f"{tmp_path}/out", clients={"rewriter": counting(str(tmp_path))})
    assert code == 0 and (out["pairs"], out["rewritten"], out["skipped_truncated"]) == (2, 2, 1)


def judge(folder, bad):
    def factory():
        def ask(prompt, model):
            if bad in prompt and Path(folder, "fail").exists():
                raise SystemExit("killed")  # no failed call, but the end of the worker
            Path(folder, "calls").mkdir(exist_ok=True)
            Path(folder, "calls", uuid.uuid4().hex).write_text(prompt)
            return "A"

        return ask

    return factory


def test_verdicts_outlive_a_failure_and_are_not_asked_for_again(spark, tmp_path):
    from driftline.plans import scoring

    cand, ref = texts(spark, 8), texts(spark, 8).withColumn("text", F.concat(F.lit("human "), "text"))
    prompts = cand.select("pair_id", F.concat(F.lit("prompt of "), "pair_id").alias("prompt"))
    how = {"names": "jmq", "prompts": prompts, "judge": judge(str(tmp_path), "web-00003"), "templates": {d: d + "|{prompt}|{candidate_a}|{candidate_b}" for d in records.DIMENSIONS}, "verdicts_path": f"{tmp_path}/verdicts", "per_batch": 2}
    (tmp_path / "fail").touch()
    with pytest.raises(Exception, match="."):
        scoring.score(cand, ref, **how)
    kept = records.read_strict(spark, f"{tmp_path}/verdicts", "verdict").count() if (tmp_path / "verdicts").exists() else 0
    (tmp_path / "fail").unlink()
    before = len(calls(tmp_path))
    out = scoring.score(cand, ref, resume=True, **how)
    assert out["jmq"]["overall"]["n"] == 8 and records.read_strict(spark, f"{tmp_path}/verdicts", "verdict").count() == 48
    assert len(calls(tmp_path)) <= 48 and sum(calls(tmp_path).values()) - before == 48 - kept
    scoring.score(cand, ref, **how)  # begins anew
    assert records.read_strict(spark, f"{tmp_path}/verdicts", "verdict").count() == 48


def test_generate_goes_on_where_it_failed(spark, capsys, tmp_path):
    pairs = texts(spark, 10).select("pair_id", F.lit("web").alias("corpus"), F.col("text").alias("prompt"), F.col("text").alias("reference_text"))
    for f in records.schema("pair"):
        if f.name not in pairs.columns:
            pairs = pairs.withColumn(f.name, F.lit(None).cast(f.dataType))
    pairs.write.parquet(f"{tmp_path}/pairs")
    clients = {"drafter": counting(str(tmp_path), "number 3 ")}
    call = ["--batch", "2", "generate", "--corpus", f"{tmp_path}/pairs", "--out", f"{tmp_path}/run"]
    (tmp_path / "fail").touch()
    assert run(spark, capsys, *call, clients=clients)[0] == 2
    (tmp_path / "fail").unlink()
    code, out, _ = run(spark, capsys, *call, clients=clients)
    assert code == 0 and out["already_done"] > 0 and out["already_done"] + out["generated"] == out["pairs"] == 10
    assert spark.read.parquet(f"{tmp_path}/run/drafts").count() == 10


# --- calls in flight


def test_calls_overlap_and_keep_their_order():
    under_way, most, lock = 0, 0, threading.Lock()

    def call(x):
        nonlocal under_way, most
        with lock:
            under_way += 1
            most = max(most, under_way)
        time.sleep(0.02 if x % 3 else 0.05)
        with lock:
            under_way -= 1
        return x * x

    began = time.monotonic()
    assert list(seams.in_flight(call, range(40), 4)) == [x * x for x in range(40)]
    assert 2 <= most <= 4 and time.monotonic() - began < 40 * 0.02


def test_what_waits_is_bounded_and_a_failure_comes_in_its_place():
    taken = []

    def items():
        for k in range(1000):
            taken.append(k)
            yield k

    out = seams.in_flight(lambda x: 1 // (5 - x), items(), 3)
    assert [next(out) for _ in range(5)] == [1 // (5 - k) for k in range(5)] and len(taken) <= 12
    with pytest.raises(ZeroDivisionError):
        next(out)
    assert list(out) == []


def test_a_rate_holds_over_all_threads():
    began = time.monotonic()
    list(seams.in_flight(lambda x: x, range(10), 5, per_second=50))
    assert time.monotonic() - began >= 9 / 50


def slow():
    def ask(prompt, model):
        time.sleep(0.1)
        if "fail" in prompt:
            raise TimeoutError
        return "A" if "yes" in prompt else "B"

    return ask


def test_judging_overlaps_within_a_task(spark):
    rows = [(f"p{k}", "overall", "model_first", ["yes", "no", "fail"][k % 3]) for k in range(24)]
    df = spark.createDataFrame(rows, "pair_id string, dimension string, order string, rendered string").coalesce(1)
    judging.judged(df.limit(1), slow).collect()  # a worker is up
    began = time.monotonic()
    got = judging.judged(df, slow, attempts=1, workers=8).collect()
    assert time.monotonic() - began < 24 * 0.1
    assert [r["pair_id"] for r in got] == [r[0] for r in rows]
    assert [r["choice"] for r in got] == ["A", "B", "invalid"] * 8


def test_batches_without_a_size_stay_few(spark, monkeypatch):
    """A batch costs seconds whatever is in it, so with many rows batches grow, not their number."""
    monkeypatch.setattr(progress, "PER_BATCH", 10)
    monkeypatch.setattr(progress, "MOST_BATCHES", 4)
    for n, most in ((25, 3), (400, 4)):
        own = spark.range(n).selectExpr("cast(id AS string) AS pair_id")
        parts = [[r["pair_id"] for r in b.collect()] for b in progress.batches(own, "pair_id")]
        assert len(parts) == most and sorted(x for p in parts for x in p) == sorted(str(k) for k in range(n))
    assert len(list(progress.batches(spark.range(40).selectExpr("cast(id AS string) AS pair_id"), "pair_id", 5))) == 8
