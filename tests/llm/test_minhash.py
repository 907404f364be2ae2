import itertools
import random
import re

import numpy as np
import pytest

from driftline.llm import minhash
from driftline.llm.common import Forest, components, sifted

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def brute(rows, width):
    sets = [(i, plain_set(t, width)) for i, t in rows]
    f = Forest()
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
            f.join(a, b)
    return {i: (len(s), f.root(i) if i is not None and s else i) for i, s in sets}


def check(docs, width, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash.near_duplicates(docs, width=width, **more).collect()
    assert len(got) == len(rows)
    want = brute(rows, width)
    for r in got:
        if r["doc_id"] is None:
            continue
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def near_copies(seed, n, words=60, changes=4):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, changes)):
            t[r.randrange(words)] = f"n{r.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd, width):
    check(odd, width)


def test_links_are_those_of_brute_force(make):
    r = random.Random(7)
    texts = [t for s in range(12) for t in near_copies(s, 8, changes=5)] + [" ".join(f"w{r.randint(0, 500)}" for _ in range(40)) for _ in range(60)]
    r.shuffle(texts)
    texts += [texts[3], texts[3].upper(), texts[3].replace(" ", "\n")]
    check(make(list(enumerate(texts))), 2)


def test_a_large_group_goes_block_by_block(make):
    check(make(list(enumerate(near_copies(1, 120, changes=3)))), 2, block=16)


def test_empty_table(make):
    assert minhash.near_duplicates(make([])).collect() == []
    got = minhash.near_duplicates(make([(1, "a b c"), (2, "d e f")])).collect()
    assert all(r["kept"] for r in got) and len(got) == 2


def test_pruning_keeps_what_is_similar_and_drops_the_rest():
    need = minhash.cutoffs(0.8, 240, 40, 1e-6)
    assert [t for t, _ in need] == [40, 80, 120, 160, 200, 240] and all(a < b for (_, a), (_, b) in itertools.pairwise(need))
    r = np.random.default_rng(0)
    base = r.integers(0, 256, 240, dtype=np.uint8)
    like = np.where(r.random((200, 240)) < 0.85, base, r.integers(0, 256, (200, 240))).astype(np.uint8)
    far = np.where(r.random((200, 240)) < 0.3, base, r.integers(0, 256, (200, 240))).astype(np.uint8)
    i, j, _ = minhash.survivors(base[None], np.concatenate([like, far]), need)
    assert len(j) == 200 and j.max() < 200


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(30)] + [(500, k) for k in range(501, 560)]
    f = Forest()
    for a, b in edges:
        f.join(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for n in {x for e in edges if e[0] != e[1] for x in e}:
        assert got[n] == f.root(n)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sifting_keeps_all_that_is_wanted(spark):
    rows, wanted = spark.range(20_000).withColumnRenamed("id", "k"), spark.range(0, 20_000, 97).withColumnRenamed("id", "k")
    got = {r["k"] for r in sifted(rows, "k", wanted).collect()}
    assert {r["k"] for r in wanted.collect()} <= got and len(got) < 400
    assert sifted(rows, "k", wanted.limit(0)).count() == 0
