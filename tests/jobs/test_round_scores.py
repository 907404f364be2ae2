import json
import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from jobs import common
from jobs import round_scores as rs

TURNS = "conv_id long, turn long, role string, text string"


def text(c, k):
    return f"pair {c} round {k} " + "some words that stay " * (5 + c % 3)


def put(spark, tmp_path, convs, rounds, extra=()):
    """Conversations with ``rounds`` rewrites each, and a document for each but the last."""
    turns = [(c, 0, "user", f"prompt {c}") for c in convs]
    turns += [(c, 1 + k, "assistant", text(c, k)) for c in convs for k in range(rounds + 1)] + list(extra)
    spark.createDataFrame(turns, TURNS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conv")
    docs = [(c, f"human text {c} " + "other words entirely " * 6) for c in convs[:-1]]
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/docs")
    return f"{tmp_path}/conv", f"{tmp_path}/docs", f"{tmp_path}/scores"


def table(spark, scores):
    return {(r["k"], r["metric"]): (r["value"], r["n"]) for r in rs.read_scores(spark, scores).collect()}


def l2(a, b):
    a, b = (Counter(w for t in x for w in t.split()) for x in (a, b))
    return math.sqrt(sum((a[w] / a.total() - b[w] / b.total()) ** 2 for w in a | b))


def test_rounds_are_scored_against_the_references_of_their_pairs(spark, tmp_path):
    convs = list(range(1, 8))
    # conversation 2 trips in its second rewrite, which is a third of the text before
    where = put(spark, tmp_path, convs, 1, [(2, 9, "assistant", "too short"), (1, 9, "assistant", text(1, 2)), (None, 1, "assistant", "no id"), (3, 3, "user", "unrelated")])
    done = rs.round_scores(spark, *where)
    got = table(spark, where[2])
    assert done == {"turns": 25, "documents": 6, "rounds": 3, "pairs": 13, "written": len(got)}
    assert [got[k, "pairs"] for k in range(3)] == [(6, 6), (6, 6), (1, 1)]
    assert got[1, "degenerate_share"] == (0.0, 7) and got[2, "degenerate_share"] == (0.5, 2) and (0, "degenerate_share") not in got
    human = {c: f"human text {c} " + "other words entirely " * 6 for c in convs}
    for k, own in ((0, convs[:-1]), (1, convs[:-1]), (2, [1])):
        assert got[k, "token_l2"][0] == pytest.approx(l2([text(c, k) for c in own], [human[c] for c in own]))
    assert got[2, "mmd2"] == (None, 1) and got[0, "mmd2"][0] is not None
    assert {m for _, m in got if m.startswith("jmq_")} == {f"jmq_{d}" for d in ("overall", "clarity", "coherence", "creativity", "depth", "relevance")}


def test_runs_repeat_and_named_rounds_leave_the_others_alone(spark, tmp_path):
    convs = list(range(1, 6))
    where = put(spark, tmp_path, convs, 2)
    rs.round_scores(spark, *where)
    first = table(spark, where[2])
    rs.round_scores(spark, *where)
    assert table(spark, where[2]) == first
    files = {p for p in Path(where[2], "k=0").glob("*.parquet")}
    where = put(spark, tmp_path, convs[:4], 1)  # a pair and a round less
    done = rs.round_scores(spark, *where, rounds=[1, 2])
    assert done["rounds"] == 2
    got = table(spark, where[2])
    assert {k: v for k, v in got.items() if k[0] == 0} == {k: v for k, v in first.items() if k[0] == 0} and set(Path(where[2], "k=0").glob("*.parquet")) == files
    assert got[1, "pairs"] == (3, 3) and {k: v for k, v in got.items() if k[0] == 2} == {(2, "pairs"): (0, 0), (2, "mmd2"): (None, 0)}
    rs.round_scores(spark, *where)
    assert {k for k, _ in table(spark, where[2])} == {0, 1}  # the whole table is replaced


def test_nothing_to_score(spark, tmp_path):
    where = put(spark, tmp_path, [1, 2], 1)
    spark.read.parquet(where[1]).limit(0).write.parquet(f"{tmp_path}/none")
    assert rs.round_scores(spark, where[0], f"{tmp_path}/none", where[2])["pairs"] == 0
    assert {m for _, m in table(spark, where[2])} == {"degenerate_share"}
    with pytest.raises(PySparkException):
        rs.round_scores(spark, f"{tmp_path}/missing", where[1], where[2])
    assert {m for _, m in table(spark, where[2])} == {"degenerate_share"}  # a run that fails leaves the table as it was


def test_other_instruments_and_configuration(spark, tmp_path):
    from pyspark.sql import functions as F

    where = put(spark, tmp_path, [1, 2, 3], 1)
    own = rs.Instruments(reply=lambda seed: F.when(F.col("order") == "model_first", "A").otherwise("B"), embedding=lambda: F.array(F.char_length("text").cast("double")), detector=lambda: F.lit(0.25))
    rs.round_scores(spark, *where, rs.Config(last_round=1, bandwidth=2.0), instruments=own)
    got = table(spark, where[2])
    assert got[1, "jmq_overall"] == (2.0, 2) and got[1, "detector_mean"] == (0.25, 2)
    assert common.read_config(spark, rs.Config, str(Path(rs.__file__).with_suffix(".json"))) == rs.Config()


def test_command_line(spark, tmp_path):
    where = put(spark, tmp_path, [1, 2, 3], 1)
    call = [sys.executable, "-m", "jobs.round_scores", "--conversations", where[0], "--documents", where[1], "--scores", where[2], "--config", "jobs/round_scores.json"]
    done = subprocess.run(call, cwd=Path(rs.__file__).parent.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.splitlines()[-1])["pairs"] == 4 and "round 1: 2 pairs" in done.stderr
    assert table(spark, where[2])[1, "pairs"] == (2, 2)
