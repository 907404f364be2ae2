import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import mixing, sharding


def test_differencing_keeps_groups_and_sums():
    r = np.random.default_rng(0)
    sums = np.zeros((500, 8), np.int64)
    sums[:, 0] = r.integers(1, 100_000, 500)
    place, total = sharding.difference(sums, 8)
    by = np.bincount(place[:, 0], sums[:, 0], 8)
    assert sorted(by) == sorted(total) and total.max() - total.min() <= 40


def test_differencing_beats_greedy_on_average():
    r, better = random.Random(2), 0
    for _ in range(30):
        sizes = [r.randint(1, 10**6) for _ in range(60)]
        sums = np.zeros((60, 4), np.int64)
        sums[:, 0] = sizes
        _, total = sharding.difference(sums, 4)
        bins = [0] * 4
        for s in sorted(sizes, reverse=True):
            bins[bins.index(min(bins))] += s
        better += (total.max() - total.min()) < max(bins) - min(bins)
    assert better >= 25


def check(rows, docs):
    texts = defaultdict(set)
    want = Counter((r["doc_id"], r["text"]) for r in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(map(len, slots.values())) == sum(want.values())
    by_id = {r["doc_id"]: r["text"] for r in docs if r["doc_id"] is not None}
    for r in rows:
        if r["doc_id"] is not None:
            t = by_id[r["doc_id"]]
            texts[t].add(r["shard"])
            assert r["size"] == len((t or "").encode()) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
            assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
    assert all(len(v) == 1 for v in texts.values())


def test_shards_of_odd_rows(odd):
    rows = sharding.shard(odd).collect()
    check(rows, odd.collect())
    assert {r["shard"] for r in rows} <= set(range(8))
    assert sharding.shard(odd.limit(0)).collect() == []


def test_shards_are_even_over_several_cells_and_runs_agree(make):
    r = random.Random(1)
    docs = make([(k, f"{k} " + "x" * r.randint(0, 3000)) for k in range(600)] + [(1000 + k, "copy " * 100) for k in range(60)])
    rows = sharding.shard(docs, cell_groups=50).collect()
    check(rows, docs.collect())
    size = Counter()
    for x in rows:
        size[x["shard"]] += x["size"]
    assert max(size.values()) - min(size.values()) < 0.002 * sum(size.values())
    again = {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.shard(docs.repartition(7), cell_groups=50).collect()}
    assert again == {x["doc_id"]: (x["shard"], x["slot"]) for x in rows}


def test_a_group_beyond_an_even_share_stands_alone(make):
    r = random.Random(2)
    docs = make([(k, f"{k} " + "x" * r.randint(0, 300)) for k in range(500)] + [(1000 + k, "hot " * 50) for k in range(300)])
    rows = sharding.shard(docs, cell_groups=60).collect()
    check(rows, docs.collect())
    hot = {x["shard"] for x in rows if x["doc_id"] >= 1000}
    size = Counter()
    for x in rows:
        size[x["shard"]] += x["size"]
    others = [v for s, v in size.items() if s not in hot]
    assert len(hot) == 1 and all(x["doc_id"] >= 1000 for x in rows if x["shard"] in hot) and max(others) - min(others) < 0.01 * sum(others)


def spread(rows):
    size = Counter()
    for x in rows:
        size[x["shard"]] += x["size"]
    return max(size.values()) - min(size.values())


@pytest.mark.parametrize("copies", [0, 60, 400])
def test_cells_even_out_what_one_differencing_does(make, copies):
    """However the groups are dealt into cells, with and without large groups, against one differencing of all of them."""
    r = random.Random(4)
    docs = make([(k, f"{k} " + "x" * r.randint(0, 6000)) for k in range(3000)] + [(10_000 + k, "copy " * 600) for k in range(copies)] + [(20_000 + k, "few " * 500) for k in range(copies // 2)])
    groups = Counter()
    for x in docs.collect():
        groups[x["text"]] += len(x["text"].encode()) + 1
    sums = np.zeros((len(groups), 8), np.int64)
    sums[:, 0] = sorted(groups.values(), reverse=True)
    _, whole = sharding.difference(sums, 8)
    rows = sharding.shard(docs, cell_groups=400).collect()
    check(rows, docs.collect())
    assert spread(rows) <= (whole.max() - whole.min()) + 8


def test_cells_of_equal_groups_do_not_add_up(make):
    docs = make([(k, f"{k:06d} " + "x" * 500) for k in range(2003)])
    assert spread(sharding.shard(docs, cell_groups=30).collect()) <= 508


def brute(lengths, counts, budget):
    best = 0
    for combo in itertools.product(*[range(c + 1) for c in counts]):
        s = sum(a * b for a, b in zip(lengths, combo, strict=True))
        best = max(best, s if s <= budget else 0)
    return best


def test_budget_fitting_is_as_near_as_can_be_on_small_cases():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 30), 4))
        counts = [r.randint(1, 4) for _ in lengths]
        budget = r.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        take = mixing.fill(np.array(lengths), np.array(counts), budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        # all that is left behind an even share is within the table's reach here, so it is met as nearly as its items allow
        total = sum(a * b for a, b in zip(lengths, counts, strict=True))
        even = [c * budget // total for c in counts] if budget < total else counts
        left = budget - sum(a * b for a, b in zip(lengths, even, strict=True))
        if left <= 2 * max(lengths):
            assert got == budget - left + brute(lengths, [c - e for c, e in zip(counts, even, strict=True)], left)
        assert brute(lengths, counts, budget) - got <= 2 * max(lengths)
    big = mixing.fill(np.arange(1, 400), np.full(399, 50), 1_234_567)
    assert int((big * np.arange(1, 400)).sum()) == 1_234_567


def test_a_knapsack_fits_where_taking_the_largest_first_does_not():
    for lengths, counts, budget, most in (([6, 9, 20], [1, 1, 1], 15, 15), ([5, 7, 8], [2, 2, 1], 14, 14), ([4, 6, 9], [1, 1, 1], 10, 10), ([3, 5, 7], [1, 1, 1], 9, 8)):
        take = mixing.fill(np.array(lengths), np.array(counts), budget)
        assert int((take * lengths).sum()) == most == brute(lengths, counts, budget)


def test_the_table_is_bounded_whatever_the_lengths(monkeypatch):
    monkeypatch.setattr(mixing, "TABLE", 1 << 12)
    lengths = np.array([1, 2, 5, 100, 40_000, 100_000_000])
    take = mixing.fill(lengths, np.array([9, 9, 9, 900, 30, 3]), 150_123_457)
    assert int((take * lengths).sum()) <= 150_123_457 and 150_123_457 - int((take * lengths).sum()) < 50_000_000


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_follow_the_plain_law(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 5, 50, 1000, 100_000]) for s in ["a", "B", "é", "z", "src10", "src2", "", None]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
    for s, t in plain_targets(sizes).items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-6)


def test_mix(make):
    r = random.Random(5)
    rows = [(k, " ".join("w" for _ in range(r.choice([0, 3, 7, 20, 150]))), "en", r.choice(["a", "a", "a", "b", "c", None])) for k in range(800)] + [(9, "w w w", "en", "a")]
    docs = make(rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    src = {}
    taken, size, target = Counter(), Counter(), {}
    for x, row in ((x, None) for x in out):
        assert x["taken"] <= 3 * x["size"] and (x["taken"] % x["size"] == 0 if x["size"] else x["taken"] == 0)
    by = defaultdict(list)
    for i, t, _, s in rows:
        by[i].append((s, len(re.findall(r"[^\x20\x09-\x0D]+", t))))
    for x in out:
        s, n = by[x["doc_id"]][0]
        src[x["doc_id"]] = s
        taken[s] += x["taken"]
        size[s] += x["size"]
        target[s] = x["target"]
        assert any(n == x["size"] for _, n in by[x["doc_id"]])
    for s in target:
        assert 0 <= target[s] - taken[s] <= 3
    again = Counter((x["doc_id"], x["size"], x["taken"]) for x in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((x["doc_id"], x["size"], x["taken"]) for x in out)


def test_common_lengths_are_ranked_in_parts(make, monkeypatch):
    docs = make([(k, "w w w", "en", "a" if k % 3 else "b") for k in range(900)])
    want = sorted((x["doc_id"], x["taken"]) for x in mixing.mix(docs).collect())
    total = Counter()
    for i, t in want:
        total["a" if i % 3 else "b"] += t
    monkeypatch.setattr(mixing, "SALT_ROWS", 5)
    got = Counter()
    for x in mixing.mix(docs.withColumns({"size": docs.doc_id, "taken": docs.doc_id, "salt": docs.doc_id, "draw": docs.doc_id})).collect():
        got["a" if x["doc_id"] % 3 else "b"] += x["taken"]
    assert got == total


def test_mix_of_odd_and_empty_tables(odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(x["taken"] <= 3 * x["size"] for x in out)
    assert mixing.mix(odd.limit(0)).collect() == []
    assert all(x["taken"] == 0 for x in mixing.mix(odd.where("doc_id < 4")).collect())


def test_word_counts(odd):
    got = [(r["text"], r["n"]) for r in odd.select("text", mixing.word_total().alias("n")).collect()]
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, n in got)


def hot(make):
    """A third of the rows have no key, a text has very many copies, and a row comes again and again."""
    rows = [(None, f"text {k} " + "x " * (k % 9), None, f"s{k % 3}") for k in range(900)] + [(10_000 + k, "the same text", None, "s1") for k in range(900)]
    return rows + [(7, "again and again", None, None)] * 700 + [(20_000 + k, f"own text {k}", None, "s2") for k in range(500)]


def test_hot_keys_texts_and_rows_are_numbered_in_parts(make, monkeypatch):
    from driftline.llm import common

    monkeypatch.setattr(common, "HUB_EDGES", 50)
    monkeypatch.setattr(common, "REPEAT", 64)
    rows = hot(make)
    docs = make(rows)
    got = sharding.shard(docs, 4).collect()
    check([r for r in got], docs.collect())
    again = sharding.shard(docs.repartition(7), 4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_takes_equal_rows_by_their_number(make, monkeypatch):
    from driftline.llm import common

    monkeypatch.setattr(common, "REPEAT", 64)
    docs = make(hot(make))
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) and len(got) == 3000
    by = defaultdict(lambda: [0, 0.0])
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    for r in got:
        by[r["source_size"], r["target"]][0] += r["taken"]
    for (size, target), (taken, _) in by.items():
        assert taken <= target and target - taken < 20, (size, target, taken)


@pytest.mark.parametrize("run", [sharding.shard, mixing.mix])
def test_clashing_columns_are_not_looked_at(odd, run):
    more = odd.selectExpr("*", "1 AS key", "2 AS n", "3 AS size", "4 AS shard", "5 AS run", "6 AS nth", "7 AS taken", "8 AS draw", "9 AS target", "'x' AS digest", "10 AS at", "11 AS salt")
    assert sorted(map(repr, run(more).collect())) == sorted(map(repr, run(odd).collect()))
