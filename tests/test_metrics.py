import math

import numpy as np
import pytest

from driftline.operators import metrics


def l2(spark, a, b):
    rows = [("a", t) for t in a] + [("b", t) for t in b]
    df = spark.createDataFrame(rows, "side string, text string")
    r = metrics.token_l2(df, []).first()
    return r["token_l2"], r["vocab_size"]


@pytest.mark.parametrize(("a", "b", "want", "vocab"), [
    (["a b"], ["a b a b a b"], 0.0, 2), (["a a a"], ["b b"], math.sqrt(2), 2), (["a a a b"], ["a b b b"], math.sqrt(0.5), 2), ([], ["a a b b"], math.sqrt(0.5), 2), ([""], [""], 0.0, 0),
])
def test_token_l2_known_answers(spark, a, b, want, vocab):
    got, n = l2(spark, a, b)
    assert got == pytest.approx(want, abs=1e-12) and n == vocab


def test_token_l2_ignores_how_often_a_set_is_repeated(spark):
    a, b = ["x y z", "y y"], ["x q"]
    assert l2(spark, a * 5, b)[0] == pytest.approx(l2(spark, a, b * 3)[0], abs=1e-12)


def frame(spark, x, y):
    rows = [(0, "a", k, [float(v) for v in np.atleast_1d(p)]) for k, p in enumerate(x)] + [(0, "b", 1000 + k, [float(v) for v in np.atleast_1d(p)]) for k, p in enumerate(y)]
    return spark.createDataFrame(rows, "g int, side string, id long, v array<double>")


def mmd(spark, x, y, sigma=None, block=3):
    return metrics.mmd2(frame(spark, x, y), "g", "side", "v", "id", sigma, block).first()


def band(spark, pool, block=2):
    df = frame(spark, pool, [])
    return metrics.bandwidth(metrics.tiles(metrics.blocks(df, "g", "side", "v", block), 2 * block * 8))


def test_mmd_by_hand(spark):
    want = math.exp(-2) + (2 + 4 * math.exp(-2)) / 6 - 2 * (5 * math.exp(-0.5) + math.exp(-4.5)) / 6
    assert mmd(spark, [0, 2], [1, 1, 3], 1.0)["mmd2"] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("pool", "want"), [([0, 1, 3], 2.0), ([0, 1, 4, 6], math.sqrt(12.5)), ([0] * 6 + [1] * 2, 1.0)])
def test_bandwidth_known_answers(spark, pool, want):
    assert band(spark, pool) == pytest.approx(want, abs=1e-9)


def test_bandwidth_by_narrowing(spark, monkeypatch):
    """Down to the last bits, with the median's two values in different bins, among ties and zeros."""
    monkeypatch.setattr(metrics, "FEW", 1)
    r = np.random.default_rng(3)
    for pool in (r.normal(size=23), np.array([0.0, 0, 0, 0, 1, 5]), np.array([0.0, 1, 3, 3, 3, 900]), r.integers(0, 4, 20).astype(float), np.array([0, 1e-9, 1, 1e9])):
        d = (pool[:, None] - pool[None]) ** 2
        d = np.maximum((pool * pool)[:, None] + (pool * pool)[None] - 2 * pool[:, None] * pool[None], 0) if len(pool) else d
        d = d[np.triu_indices(len(pool), 1)]
        median = np.median(d) or np.median(d[d > 0])
        assert band(spark, pool.tolist(), block=8) == pytest.approx(math.sqrt(median), rel=1e-12)


@pytest.mark.parametrize("miss", [None, (0.0, 1e-9), (1e8, 1e9), (0.5, 0.5000001)])
def test_a_bracket_saves_passes_and_one_that_misses_costs_only_time(spark, monkeypatch, miss):
    x = np.random.default_rng(8).normal(size=(401, 5))
    written = metrics.blocks(frame(spark, x, []), "g", "side", "v", 64)
    made, ends, passes = metrics.tiles(written), metrics.bracket(written), []
    assert 0 < ends[0] < ends[1]
    run = metrics.over_tiles
    monkeypatch.setattr(metrics, "over_tiles", lambda *a: passes.append(1) or run(*a))
    d = ((x[:, None] - x[None]) ** 2).sum(2)[np.triu_indices(len(x), 1)]
    assert ends[0] < np.median(d) < ends[1]
    assert metrics.bandwidth(made, miss or ends) == pytest.approx(math.sqrt(np.median(d)), rel=1e-12)
    assert len(passes) == (2 if miss is None else len(passes)) and (miss is None or len(passes) > 2)


def test_a_bracket_of_ties_and_of_many_values_in_one_bin(spark, monkeypatch):
    r = np.random.default_rng(9)
    for pool in (r.integers(0, 3, 300).astype(float), np.append(r.random(300), 1e6), np.zeros(300)):
        written = metrics.blocks(frame(spark, pool, []), "g", "side", "v", 64)
        d = np.maximum((pool * pool)[:, None] + (pool * pool)[None] - 2 * pool[:, None] * pool[None], 0)[np.triu_indices(len(pool), 1)]
        if not d.any():
            assert metrics.bracket(written) is None
            continue
        want = np.median(d) or np.median(d[d > 0])
        for few in (metrics.FEW, 5):
            monkeypatch.setattr(metrics, "FEW", few)
            assert metrics.bandwidth(metrics.tiles(written), metrics.bracket(written)) == pytest.approx(math.sqrt(want), rel=1e-9)
        monkeypatch.undo()


def met(tile):
    """(number of pairs of vectors, of pairs of blocks) of a tile, as a table."""
    found = [len(d) * (len(d) - 1) // 2 if same else d.size for d, _, _, same in metrics.block_pairs(tile)]
    return metrics.pa.table({"pairs": [sum(found)], "blocks": [len(found)]})


@pytest.mark.parametrize("side", [1, 3, 100])
def test_a_block_moves_once_a_band_and_every_pair_is_met_once(spark, side):
    made = metrics.blocks(frame(spark, range(240), []), "g", "side", "v", 8)
    n, width = made.count(), made.selectExpr("max(size(v)) * 8").first()[0]
    tiles = metrics.tiles(made, side * width)
    bands = -(-n // side)
    assert tiles.count() == n * bands and tiles.select("i", "j").distinct().count() == bands * (bands + 1) // 2
    got = metrics.over_tiles(tiles, met, "pairs long, blocks long").selectExpr("sum(pairs) AS p", "sum(blocks) AS b").first()
    assert (got["p"], got["b"]) == (240 * 239 // 2, n * (n + 1) // 2)


def test_what_moves_grows_with_blocks_and_bands(spark):
    """Bytes of vectors on the grid: pairwise they would grow with the square of the blocks."""
    moved = {}
    for n in (256, 1024):
        made = metrics.blocks(frame(spark, range(n), []), "g", "side", "v", 8)
        blocks, bands = made.count(), -(-made.count() // 16)
        moved[n] = metrics.tiles(made, 16 * made.selectExpr("max(size(v)) * 8").first()[0]).selectExpr("sum(size(v) * 8)").first()[0]
        assert moved[n] == n * 8 * bands and bands <= blocks / 16 + 1
    assert moved[1024] < 1024 * 8 * 1024 / 8 / 8


def test_equal_rows_and_null_keys_fill_blocks_evenly(spark):
    rows = [(0, "a", None, [1.0, 2.0])] * 3000 + [(0, "b", 7, [1.0, 2.0])] * 1000
    made = metrics.blocks(spark.createDataFrame(rows, "g int, side string, id long, v array<double>"), "g", "side", "v", 100)
    sizes = [r[0] for r in made.selectExpr("size(v)").collect()]
    assert sum(sizes) == 4000 and len(sizes) == 40 and max(sizes) < 200


def test_splits_in_one_pass_are_those_made_one_by_one(spark):
    r, n, splits = np.random.default_rng(5), 37, 5
    marks = [[int(x) for x in r.integers(0, 3, splits)] for _ in range(n)]
    rows = [(f"p{k}", " ".join(r.choice(["a", "b", "c", "d e"], 6)), [float(x) for x in r.normal(size=3)], marks[k]) for k in range(n)]
    df = spark.createDataFrame(rows, "pair_id string, text string, v array<double>, marks array<byte>")
    mmd_ = {x["split"]: x for x in metrics.mmd2_of_splits(df, "v", splits, 1.5, block=8, tile_bytes=2 * 8 * 8 * 3).collect()}
    l2_ = {x["split"]: x for x in metrics.token_l2_of_splits(df, splits).collect()}
    for k in range(splits):
        a, b = ([x for x in rows if x[3][k] == h] for h in (1, 2))
        one = mmd(spark, [x[2] for x in a], [x[2] for x in b], 1.5)
        assert mmd_[k]["mmd2"] == pytest.approx(one["mmd2"], abs=1e-12) and (mmd_[k]["n"], mmd_[k]["m"]) == (len(a), len(b))
        got, vocab = l2(spark, [x[1] for x in a], [x[1] for x in b])
        assert l2_[k]["token_l2"] == pytest.approx(got, abs=1e-9) and l2_[k]["vocab_size"] == vocab
    halves = df.selectExpr("pair_id", "posexplode(marks) AS (split, m)").selectExpr("pair_id", "split", "CASE m WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS half")
    assert sorted(map(tuple, metrics.split_marks(halves, splits, "split", "pair_id").collect())) == sorted((x[0], x[3]) for x in rows)


def test_bandwidth_of_coinciding_vectors_is_an_error(spark):
    with pytest.raises(ValueError, match="coincide"):
        band(spark, [1, 1, 1])


def oracle(x, y):
    pool = np.vstack([x, y])
    d = ((pool[:, None] - pool[None]) ** 2).sum(2)
    sigma = math.sqrt(np.median(d[np.triu_indices(len(pool), 1)]))
    k = np.exp(-d / (2 * sigma**2))
    n, m = len(x), len(y)
    xx, yy, xy = k[:n, :n], k[n:, n:], k[:n, n:]
    return (xx.sum() - n) / (n * (n - 1)) + (yy.sum() - m) / (m * (m - 1)) - 2 * xy.mean(), sigma


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_mmd_matches_a_plain_computation(spark, shift):
    r = np.random.default_rng(0)
    x, y = r.normal(size=(70, 6)), r.normal(size=(90, 6)) + shift
    got, (want, sigma) = mmd(spark, x, y, block=32), oracle(x, y)
    assert got["mmd2"] == pytest.approx(want, abs=1e-9) and got["bandwidth"] == pytest.approx(sigma, abs=1e-9)
    back = mmd(spark, y, x, block=32)
    assert back["mmd2"] == pytest.approx(got["mmd2"], abs=1e-9)
    assert (got["mmd2"] > 0.3) == (shift > 0)


def test_mmd_needs_two_on_either_side(spark):
    with pytest.raises(Exception, match="two vectors"):
        mmd(spark, [0], [1, 2, 3], 1.0)
    with pytest.raises(ValueError, match="positive"):
        mmd(spark, [0, 1], [1, 2], 0.0)


def test_vector_problems(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [float("nan"), 1.0]), (1, []), (1, None), (2, [1.0])], "g int, embedding array<double>")
    got = {r["g"]: r for r in metrics.vector_problems(df, "g").collect()}
    assert (got[1]["n"], got[1]["empty"], got[1]["not_finite"], got[1]["dim_max"]) == (4, 2, 1, 2)


def test_no_tile_takes_longer_as_the_input_grows(spark):
    """Narrow vectors once put half a million rows in one tile; many blocks meet in more tiles, each in a task of its own."""
    tasks = {}
    for n in (16, 200, 800):
        made = spark.range(n).selectExpr("0 AS g", "cast(id AS int) AS b", "array('a') AS s", "array(array(cast(id AS double))) AS v")
        dealt = metrics.tiles(made)
        sizes = [r[0] for r in dealt.groupBy("i", "j").count().select("count").collect()]
        assert max(sizes) <= 2 * metrics.TILE_BLOCKS and dealt.rdd.getNumPartitions() == len(sizes)
        tasks[n] = len(sizes)
        got = metrics.over_tiles(dealt, met, "pairs long, blocks long").selectExpr("sum(blocks) AS b").first()
        assert got["b"] == n * (n + 1) // 2
    assert tasks[16] >= 2 * spark.sparkContext.defaultParallelism and tasks[800] > 4 * tasks[200] > 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_longer_than_a_strip(spark, monkeypatch, kind):
    monkeypatch.setattr(metrics, "TILE_BLOCKS", 2)
    r = np.random.default_rng(4)
    x, y = (r.normal(size=(n, 5)).astype(np.float32).astype(float) for n in (500, 420))
    rows = frame(spark, x, y).withColumn("v", metrics.F.col("v").cast(f"array<{kind}>"))
    want, sigma = oracle(x, y)
    for block in (1024, 300):
        got = metrics.mmd2(rows, "g", "side", "v", "id", None, block).first()
        assert got["mmd2"] == pytest.approx(want, abs=1e-9) and got["bandwidth"] == pytest.approx(sigma, abs=1e-9)
    written = metrics.blocks(rows, "g", "side", "v")
    assert dict(written.dtypes)["v"] == f"array<array<{kind}>>"
    assert all(len(d) <= metrics.STRIP for d, *_ in metrics.block_pairs(metrics.tiles(written).toArrow()))
