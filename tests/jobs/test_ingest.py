import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import common, ingest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def body(k):
    return f"topic {k} " + "plain words here " * 60


def docs(spark, rows):
    return spark.createDataFrame([(k, t, g, s, None) for k, t, g, s in rows], DOCS)


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def held(spark, corpus):
    return sorted((r["source"] or "", r["content_sha256"]) for r in ingest.read_corpus(spark, corpus).collect())


def sha(text):
    return hashlib.sha256(text.strip().encode()).hexdigest()


def test_two_runs_over_growing_input_take_only_what_is_new(spark, tmp_path):
    where = f"{tmp_path}/in", f"{tmp_path}/corpus", f"{tmp_path}/state"
    put(docs(spark, [(1, body(1), "en", "a"), (2, body(1), "en", "a"), (3, body(1), "en", "b"), (4, "short", "en", "a"), (5, body(5), "de", "a")]), where[0])
    before = spark.conf.get(PROVIDER)
    first = ingest.ingest(spark, *where)
    assert first == {"batches": 1, "read": 5, "written": 2}
    files = {p: p.stat().st_mtime_ns for p in Path(where[1]).rglob("*.parquet")}
    put(docs(spark, [(6, body(1), "en", "a"), (7, body(7), None, None), (8, None, "en", "a"), (None, f"  {body(8)}\n", "en", "c"), (9, body(9), "en", ""), (7, body(7), None, None)]), where[0])
    assert ingest.ingest(spark, *where) == {"batches": 1, "read": 6, "written": 3}
    assert held(spark, where[1]) == sorted([("a", sha(body(1))), ("b", sha(body(1))), ("", sha(body(7))), ("c", sha(body(8))), ("", sha(body(9)))])
    assert {p: p.stat().st_mtime_ns for p in files} == files  # nothing that was there was written again
    assert ingest.ingest(spark, *where) == {"batches": 0, "read": 0, "written": 0}
    assert spark.conf.get(PROVIDER) == before
    row = ingest.read_corpus(spark, where[1]).where(F.col("source") == "c").first()
    assert row["text"] == body(8).strip() and row["shard"] == sha(body(8))[0] and row["word_count"] == 182 and row["n_chars"] == len(row["text"])
    assert (Path(where[1]) / f"shard={row['shard']}").is_dir()


def test_the_order_of_deliveries_and_the_size_of_batches_do_not_matter(spark, tmp_path):
    rows = [[(k, body(k % 7), "en", "ab"[k % 2]) for k in range(a, a + 6)] for a in (0, 6, 12, 18)]
    got = []
    for n, order in enumerate(([0, 1, 2, 3], [3, 1, 0, 2], [2])):
        where = f"{tmp_path}/in{n}", f"{tmp_path}/corpus{n}", f"{tmp_path}/state{n}"
        for k in order if len(order) > 1 else range(4):
            put(docs(spark, rows[k]), where[0])
            if n:
                ingest.ingest(spark, *where)
        done = ingest.ingest(spark, *where, ingest.Config(files_per_batch=1))
        assert done["batches"] == (0 if n else 4)
        got.append(held(spark, where[1]))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(set(got[0])) == 14


def test_a_run_that_fails_keeps_its_finished_batches_and_is_taken_up(spark, tmp_path):
    where = f"{tmp_path}/in", f"{tmp_path}/corpus", f"{tmp_path}/state"
    put(docs(spark, [(1, body(1), "en", "a")]), where[0])
    assert ingest.ingest(spark, *where)["written"] == 1
    put(docs(spark, [(2, body(2), "en", "a")]), where[0])
    bad = max(Path(where[0]).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    good = bad.read_bytes()
    bad.write_bytes(b"PAR1 torn")
    (bad.parent / f".{bad.name}.crc").unlink()
    before = spark.conf.get(PROVIDER)
    with pytest.raises(StreamingQueryException):
        ingest.ingest(spark, *where)
    assert held(spark, where[1]) == [("a", sha(body(1)))] and spark.conf.get(PROVIDER) == before
    bad.write_bytes(good)
    assert ingest.ingest(spark, *where)["written"] == 1
    assert held(spark, where[1]) == sorted([("a", sha(body(1))), ("a", sha(body(2)))])


def test_empty_input_and_other_columns(spark, tmp_path):
    where = f"{tmp_path}/in", f"{tmp_path}/corpus", f"{tmp_path}/state"
    more = docs(spark, [(1, body(1), "en", "a")]).selectExpr("*", "1 AS shard", "2 AS word_count", "'x' AS content_sha256", "3 AS read")
    put(more.limit(0), where[0])
    assert ingest.ingest(spark, *where)["written"] == 0
    put(more, where[0])
    assert ingest.ingest(spark, *where)["written"] == 1 and held(spark, where[1]) == [("a", sha(body(1)))]


def test_refused_documents_are_counted_by_the_first_check(spark, tmp_path):
    rows = [(1, body(1), "en", "a"), (2, None, "en", "a"), (3, " \n", "en", None), (4, "short", "de", "a"), (5, body(5), "de", "a"), (6, "é" * 400 + body(6), None, "b"), (7, "subscribe\n" + body(7), "en", "b")]
    put(docs(spark, rows), f"{tmp_path}/in")
    got = {(r["source"], r["reason"]): r["n"] for r in ingest.refused(spark, f"{tmp_path}/in").collect()}
    assert got == {("a", "blank"): 1, (None, "blank"): 1, ("a", "words"): 1, ("a", "language"): 1, ("b", "language"): 1, ("b", "boilerplate"): 1}


def test_configuration(spark, tmp_path):
    assert common.read_config(spark, ingest.Config, None) == ingest.Config() == common.read_config(spark, ingest.Config, str(Path(ingest.__file__).with_suffix(".json")))
    (tmp_path / "c.json").write_text('{"word_mim": 3}')
    with pytest.raises(ValueError, match="word_mim"):
        common.read_config(spark, ingest.Config, f"{tmp_path}/c.json")
    put(docs(spark, [(1, "just four words here", "en", "a")]), f"{tmp_path}/in")
    own = ingest.Config(word_min=4, word_max=4, shard_digits=2)
    assert ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/corpus", f"{tmp_path}/state", own)["written"] == 1
    assert len(ingest.read_corpus(spark, f"{tmp_path}/corpus").first()["shard"]) == 2


def test_command_line(spark, tmp_path):
    put(docs(spark, [(1, body(1), "en", "a"), (2, "short", "en", "a")]), f"{tmp_path}/in")
    call = [sys.executable, "-m", "jobs.ingest", "--documents", f"{tmp_path}/in", "--corpus", f"{tmp_path}/corpus", "--checkpoint", f"{tmp_path}/state", "--config", "jobs/ingest.json", "--report", f"{tmp_path}/refused"]
    done = subprocess.run(call, cwd=Path(ingest.__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.splitlines()[-1]) == {"batches": 1, "read": 2, "written": 1}
    assert "1 texts written" in done.stderr and held(spark, f"{tmp_path}/corpus") == [("a", sha(body(1)))]
    assert spark.read.json(f"{tmp_path}/refused").first()["reason"] == "words"
