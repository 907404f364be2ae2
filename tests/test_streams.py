from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftline import session
from driftline.operators import cache, judging, progress, seams
from driftline.sources import records
from driftline.streaming import incremental, verdicts

KIND = "pair_id string, dimension string, judge_model string, order string, raw_response string, choice string, retry_count int, model_won boolean"


def made(spark, n):
    rows = []
    for k in range(n):
        order = "model_first" if k % 3 else "human_first"
        for d in records.DIMENSIONS[: 1 + k % 6]:
            choice = ["A", "B", "invalid"][(k + len(d)) % 3]
            rows.append((f"p{k}", d, "j", order, "", choice, 0, None if choice == "invalid" else (choice == "A") == (order == "model_first")))
    return spark.createDataFrame(rows, KIND)


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 2, 0], [2, 2, 0, 3, 1, 0]])
def test_scores_follow_the_log_whatever_order_it_comes_in(spark, tmp_path, order):
    own = made(spark, 40).withColumn("part", F.pmod(F.xxhash64("pair_id", "dimension"), F.lit(4)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for n, k in enumerate(order):  # each call is a restart from the checkpoint
        records.write_lines(own.where(F.col("part") == k).drop("part"), f"{tmp_path}/log", "verdict")
        if n == 1:
            Path(tmp_path, "log", "bad.json").write_text('{"pair_id": null}\n{broken\n')
        verdicts.keep_scores(verdicts.log(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/state")
        seen = own.where(F.col("part").isin(order[: n + 1])).drop("part")
        assert table(spark.read.parquet(f"{tmp_path}/out/scores"), "dimension") == table(judging.scores(seen), "dimension")
        assert spark.read.parquet(f"{tmp_path}/out/order").first().asDict() == judging.order_audit(seen).first().asDict()
    files = sorted(Path(tmp_path, "out/scores").glob("*.parquet"))
    verdicts.keep_scores(verdicts.log(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(Path(tmp_path, "out/scores").glob("*.parquet")) == files
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_batch_costs_what_is_new(spark, tmp_path):
    """The sink is not read for what is known: with its files gone from sight the keys are known all the same."""
    df = spark.createDataFrame([(f"p{k}", "x") for k in range(50)], "pair_id string, text string")
    go = lambda: incremental.append_new(incremental.documents(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/sink", f"{tmp_path}/state")
    df.write.parquet(f"{tmp_path}/in")
    assert go() == 50
    for p in Path(tmp_path, "sink").glob("*.parquet"):
        p.rename(tmp_path / p.name)
    df.unionByName(spark.createDataFrame([("new", "y"), (None, "z"), (None, "z")], df.schema)).write.mode("append").parquet(f"{tmp_path}/in")
    assert go() == 2
    for p in tmp_path.glob("*.parquet"):
        p.rename(tmp_path / "sink" / p.name)
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 52


def test_null_texts_and_two_writers_leave_the_cache_sound(spark, tmp_path):
    t = spark.createDataFrame([("p1", "x"), ("p2", None), ("p3", "x"), ("p4", None), ("p5", "")], "pair_id string, text string")
    path = f"{tmp_path}/cache"
    got = {r["pair_id"]: r["vector"] for r in cache.embed(t, path, "e", seams.stub_embedder).collect()}
    assert got["p2"] is None and got["p4"] is None and got["p1"] == got["p3"] is not None and len(got["p5"]) == 8
    assert cache.read(spark, path).count() == 2
    held = cache.read(spark, path).persist()
    held.count()
    held.write.mode("append").partitionBy("embedder_id").parquet(path)  # another run that began at the same time
    held.unpersist()
    again = cache.embed(t, path, "e", seams.no_embedder)
    assert again.count() == 5 and {r["pair_id"]: r["vector"] for r in again.collect()} == got
    spark.createDataFrame([(held.first()["content_sha256"], [9.0] * 8, "e")], cache.SCHEMA).write.mode("append").partitionBy("embedder_id").parquet(path)
    with pytest.raises(cache.CacheError):
        cache.embed(t, path, "e", seams.no_embedder)


def failing():
    done = []

    def embed(texts):
        done.append(texts)
        if any("7" in x for x in texts):
            raise RuntimeError("no more")
        return seams.stub_embedder()(texts)

    return embed


def test_what_is_embedded_outlives_a_failure(spark, tmp_path):
    t = spark.createDataFrame([(f"p{k}", f"text {k}") for k in range(10)], "pair_id string, text string")
    with pytest.raises(Exception, match="no more"):
        cache.embed(t, f"{tmp_path}/cache", "e", failing, per_batch=1)
    kept = incremental.have(spark, f"{tmp_path}/cache", cache.SCHEMA).count()
    assert kept < 10
    assert cache.embed(t, f"{tmp_path}/cache", "e", seams.stub_embedder, per_batch=3).count() == 10
    assert cache.read(spark, f"{tmp_path}/cache").count() == 10


def test_intermediates_go_with_their_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")
    names = lambda: [p.name.split("-")[0] for p in Path(tmp_path, "shared").iterdir()]
    kept = session.cut(spark.range(3), "kept")
    with session.intermediates(spark):
        assert session.cut(spark.range(5), "gone").count() == 5
    assert names() == ["kept"] and kept.count() == 3
    with pytest.raises(ZeroDivisionError), session.intermediates(spark):
        session.cut(spark.range(5), "gone")
        raise ZeroDivisionError
    assert names() == ["kept"]
    progress.append(spark.createDataFrame([("a",)], "pair_id string"), f"{tmp_path}/sink", "pair_id string", lambda rows: rows)
    assert names() == ["kept"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
