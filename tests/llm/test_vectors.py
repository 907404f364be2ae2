import math
import random

import numpy as np
import pytest

from driftline.llm import egojoin
from driftline.llm.common import Forest

KIND = "vec_id long, embedding array<float>, label int, key string"


def brute(rows, threshold=0.93):
    able = [(i, k, np.array(v, float), lab) for k, (i, v, lab, _) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, f = dict.fromkeys(range(len(rows)), 0), Forest()
    for a in range(len(able)):
        for b in range(a + 1, len(able)):
            i, p, x, lx = able[a]
            j, q, y, ly = able[b]
            if lx == ly and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[p] += 1
                n[q] += 1
                f.join(i, j)
    return [(r[0], n[k], f.root(r[0]) if r[0] is not None else None) for k, r in enumerate(rows)]


def check(spark, rows, **more):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab, "x") for i, v, lab in rows]
    got = egojoin.near_vectors(spark.createDataFrame(rows, KIND), **more).collect()
    key = lambda t: (t[0] is None, t[0], t[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) or r["vec_id"] is None for r in got)


def groups(seed, n, dim=16, spread=0.06):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(k, list(centres[k % 12] + r.normal(size=dim) * spread * (k % 5)), int(k % 3)) for k in range(n)]


def test_links_are_those_of_brute_force(spark):
    check(spark, groups(0, 400))


def test_small_blocks_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(egojoin, "LEAF", 4)
    check(spark, groups(1, 200, dim=3), block=16)
    check(spark, groups(2, 150, dim=2, spread=0.3), block=8)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0),
            (10, [1.0, float("inf"), 3.0], 0), (11, v, 1), (12, [1.0, 2.0], 0), (None, v, 0), (13, [-1.0, -2.0, -3.0], 0), (14, [1.0, 2.0], 0)]
    check(spark, rows)
    check(spark, [(1, v, 0), (1, v, 0), (2, v, 0)])
    check(spark, [(5, None, 0)])
    check(spark, [])


def test_a_threshold_must_be_between(spark):
    with pytest.raises(ValueError, match="threshold"):
        egojoin.near_vectors(spark.createDataFrame([], KIND), 1.5)


def test_distant_halves_are_skipped():
    r = random.Random(0)
    far = {"id": np.arange(100), "unit": np.zeros((100, 2)), "raw": np.zeros((100, 2)), "at": np.array([[10.0 + r.random(), 0.0] for _ in range(100)])}
    near = {"id": np.arange(100, 200), "unit": None, "raw": None, "at": np.zeros((100, 2))}
    na, nb, f = egojoin.join_blocks(near, far, 0.93, 0.37)
    assert not na.any() and not nb.any() and not f.up


def test_components_of_hubs_and_chains(spark, monkeypatch):
    """A star larger than what counts as a hub, chains, and rounds that don't suffice."""
    from driftline.llm import common

    edges = [(0, k) for k in range(1, 900)] + [(5000 + k, 5001 + k) for k in range(200)] + [(7, 5100), (9000, 9001), (9001, 9000), (9002, 9002)]
    df = spark.createDataFrame(edges, "a long, b long")
    f = Forest()
    for a, b in edges:
        if a != b:
            f.join(a, b)
    want = {x: f.root(x) for x in list(f.up)}
    for least in (common.HUB_EDGES, 3, 10**9):
        monkeypatch.setattr(common, "HUB_EDGES", least)
        got = [(r["node"], r["component"]) for r in common.components(df).collect()]
        assert len(got) == len(want) and dict(got) == want
    with pytest.raises(RuntimeError, match="rounds"):
        common.components(df, max_rounds=1)
    assert common.components(df.limit(0)).collect() == []


def test_a_join_with_hot_keys_is_a_join(spark, monkeypatch):
    from driftline.llm import common

    rows = spark.createDataFrame([(k % 5 if k < 90 else None, k) for k in range(100)], "g long, x long")
    table = spark.createDataFrame([(0, 18, "a"), (1, 18, "b"), (2, 2, "c"), (9, 1, "d")], "g long, n long, name string")
    want = sorted((r["x"], r["name"]) for r in rows.join(table, "g").collect())
    for least in (1, 10, 1000):
        monkeypatch.setattr(common, "HUB_EDGES", least)
        out = common.joined(rows, table, "g", 100)
        assert out.columns == ["g", "x", "name"] and sorted((r["x"], r["name"]) for r in out.collect()) == want
