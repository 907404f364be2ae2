import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import lm


def corpus(make, n=400):
    r = random.Random(0)
    return make([(k, " ".join(f"w{(s + j) % 40}" for j in range(r.randint(20, 60)))) for k in range(n) for s in [r.randint(0, 39)]])


class ids_of(dict):  # noqa: N801
    """Id of any word."""

    def __init__(self, vocab):
        super().__init__(vocab.ids())

    def __missing__(self, word):
        return lm.shared_id(lm.bucket_of(word))


def plain(net, ids):
    """Summed log probabilities by the unrounded network, one token at a time."""
    pad = [0] * lm.SIDE + list(ids) + [0] * lm.SIDE
    log = lambda z, k: z[k] - np.log(np.exp(z).sum())
    out = []
    for p in range(lm.SIDE, lm.SIDE + len(ids)):
        x = np.concatenate([net.embed[pad[p + k]] for k in lm.OFFSETS]).astype(float)
        h = np.tanh(x @ net.inner + net.inner_bias)
        at = pad[p] - 1 - lm.DIRECT
        h = np.append(h, 1.0)
        out.append(log(h @ net.first, pad[p] - 1 if at < 0 else lm.DIRECT + at // lm.WIDTH))
        if at >= 0:
            g = at // lm.WIDTH
            out[-1] += log(h @ net.second[g], at % lm.WIDTH)
    return sum(out)


def shares(vocab, words, counts):
    """Summed logs of the words' shares of their shared ids."""
    rest = [w for w in words if w not in vocab]
    return sum(np.log(counts[w] or 1) - np.log(vocab.behind[lm.bucket_of(w)] + 1) for w in rest)


def test_scores_are_those_of_a_plain_loop(make, odd):
    """Over whole texts, the longest among them."""
    docs = odd.unionByName(corpus(make, 40))
    vocab, net = lm.fit(docs)
    texts = [(x["doc_id"], lm.words_of(x["text"])) for x in docs.collect()]
    counts = Counter(w for _, ws in texts for w in ws)
    ids, want = ids_of(vocab), Counter()
    for k, ws in texts:
        want[k, len(ws), round((plain(net, [ids[w] for w in ws]) + shares(vocab, ws, counts)) / max(1, len(ws)), 1)] += 1
    got = lm.score(docs, vocab, net).collect()
    assert len(got) == len(texts)
    for r in got:
        near = [k for k in want if k[0] == r["doc_id"] and k[1] == r["n_tokens"] and abs(k[2] - (r["pll_per_token"] or 0)) < 0.06]
        assert near and (r["pll_per_token"] is None) == (r["n_tokens"] == 0) and r["pll"] == pytest.approx((r["pll_per_token"] or 0) * r["n_tokens"], abs=1e-3 + 1e-6 * r["n_tokens"])


def test_odd_and_empty_tables(make, odd):
    vocab, net = lm.fit(odd)
    assert lm.score(odd, vocab, net).count() == odd.count()
    none, fresh = lm.fit(make([]))
    assert none == [] and lm.pseudo_likelihood(make([])).collect() == [] and lm.score(make([]), none, fresh).collect() == []


def windows(docs, shards=3):
    """All training windows with their weights."""
    blocks = lm.numbered(docs)
    vocab = lm.frequent(blocks)
    out = Counter()
    for r in lm.pieces(blocks, vocab, shards).collect():
        rows, weight = lm.rows_of([bytes(r["flat"])], np.array([r["weight"]]))
        out.update({tuple(x): 0 for x in rows.tolist()})
        for x, w in zip(rows.tolist(), weight.tolist(), strict=True):
            out[tuple(x)] += int(w)
    return vocab, out


def test_every_token_is_a_window_once(make, odd):
    docs = odd.unionByName(corpus(make, 60)).unionByName(make([(100 + k, "short") for k in range(40)]))
    vocab, got = windows(docs)
    ids, want = ids_of(vocab), Counter()
    for r in docs.collect():
        pad = [0] * lm.SIDE + [ids[w] for w in lm.words_of(r["text"])] + [0] * lm.SIDE
        for p in range(lm.SIDE, len(pad) - lm.SIDE):
            want[tuple(pad[p + k] for k in [*lm.OFFSETS, 0])] += 1
    assert got == want and want[0, 0, 0, 0, ids[b"short"]] == 40


def test_windows_grow_with_the_corpus(make):
    docs = corpus(make, 60)
    once, twice = windows(docs)[1], windows(docs.unionByName(docs))[1]
    assert twice == Counter({k: 2 * n for k, n in once.items()})


def test_scores_do_not_depend_on_how_rows_are_dealt(make, odd):
    docs = odd.unionByName(corpus(make, 300))
    got = [sorted(map(str, lm.pseudo_likelihood(d).collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.repartition(5, "text"))]
    assert got[0] == got[1] == got[2] and len(got[0]) == docs.count()


def test_an_equal_piece_counts_as_often_as_it_comes():
    r = np.random.default_rng(0)
    rows = r.integers(1, 50, (300, 5)).astype(np.uint16)
    one, two = lm.Net.start(), lm.Net.start()
    one.train(rows, np.full(300, 2.0, np.float32))
    two.train(rows)
    assert np.allclose(one.flat(), two.flat(), atol=1e-4)
    heavy = np.ones(300, np.float32)
    heavy[:100] = 3
    three, four = lm.Net.start(), lm.Net.start()
    steps = lm.STEP
    try:
        lm.STEP = (1000, 1000)  # one step, so that order and batches are out of it
        three.train(rows, heavy)
        four.train(np.concatenate([rows, rows[:100], rows[:100]]))
    finally:
        lm.STEP = steps
    assert np.allclose(three.flat(), four.flat(), atol=1e-3)


def test_the_gradient_lowers_the_loss():
    r = np.random.default_rng(0)
    for lo, hi in ((1, 20), (lm.DIRECT + 1, lm.DIRECT + 20), (lm.VOCAB - 400, lm.VOCAB)):
        t = r.integers(lo, hi, 4000)
        rows = np.stack([t, t, t, t, t], 1).astype(np.uint16)
        net = lm.Net.start()
        flat = np.array([0, 0, *[lo + 3] * 5, 0, 0], np.uint16)
        before = net.rounded().log_probs(flat, np.array([4]))[0]
        net.train(rows)
        assert net.rounded().log_probs(flat, np.array([4]))[0] > before + 1


def test_the_gradient_is_that_of_the_loss():
    """One step of Adagrad from nothing moves every parameter against the sign of its numerical gradient."""
    r = np.random.default_rng(1)
    rows = r.integers(1, 300, (64, 5)).astype(np.uint16)
    net = lm.Net.start()
    net.first += r.normal(0, 0.2, net.first.shape).astype(np.float32)
    net.second += r.normal(0, 0.2, net.second.shape).astype(np.float32)

    def loss(n):
        total = 0.0
        for row in rows.tolist():
            x = np.concatenate([n.embed[c] for c in row[:-1]]).astype(float)
            h, at = np.tanh(x @ n.inner + n.inner_bias), row[-1] - 1 - lm.DIRECT
            h = np.append(h, 1.0)
            z = h @ n.first
            total += np.log(np.exp(z).sum()) - z[row[-1] - 1 if at < 0 else lm.DIRECT + at // lm.WIDTH]
            if at >= 0:
                z = h @ n.second[at // lm.WIDTH]
                total += np.log(np.exp(z).sum()) - z[at % lm.WIDTH]
        return total

    after = lm.Net.from_flat(net.flat())
    after.train(rows)
    used = int(rows[0, 0]), int(rows[:, -1].max())
    group = (used[1] - 1 - lm.DIRECT) // lm.WIDTH
    for k, at in ((0, (used[0], 3)), (1, (5, 7)), (2, (4,)), (3, (2, lm.DIRECT + group)), (3, (lm.HIDDEN, lm.DIRECT + group)), (4, (group, 3, (used[1] - 1 - lm.DIRECT) % lm.WIDTH)), (4, (group, lm.HIDDEN, (used[1] - 1 - lm.DIRECT) % lm.WIDTH))):
        moved = after.arrays()[k][at] - net.arrays()[k][at]
        up, down = lm.Net.from_flat(net.flat()), lm.Net.from_flat(net.flat())
        up.arrays()[k][at] += 1e-2
        down.arrays()[k][at] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        if abs(slope) > 0.05:
            assert np.sign(moved) == -np.sign(slope), (k, at, moved, slope)


def test_every_word_has_a_probability_of_its_own(make):
    often = [f"w{k}" for k in range(lm.FREQUENT)]
    a, b, never = [w for w in (f"rare{k}" for k in range(20_000)) if lm.bucket_of(w.encode()) == lm.bucket_of(b"rare0")][:3]
    vocab, net = lm.fit(make([(k, " ".join(often)) for k in range(5)] + [(20, f"{a} {b} {a} w1 {a}"), (21, f"{b} {a} other")]))
    assert sorted(vocab) == sorted(w.encode() for w in often)
    r = ids_of(vocab)
    got = {x["doc_id"]: x for x in lm.score(make([(1, a), (2, b), (3, never), (4, "w1"), (5, f"w1 {a} w2 {b} w3"), (6, f"w1 {b} w2 {a} w3"), (None, a)]), vocab, net).collect()}
    # four, two and no occurrences among the shared id's
    assert got[1]["pll"] - got[2]["pll"] == pytest.approx(np.log(2), abs=1e-3) and got[2]["pll"] - got[3]["pll"] == pytest.approx(np.log(2), abs=1e-3)
    behind = sum(c for w, c in ((a, 4), (b, 2), ("other", 1)) if lm.bucket_of(w.encode()) == lm.bucket_of(a.encode()))
    assert got[1]["pll"] == pytest.approx(plain(net, [r[a.encode()]]) + np.log(4 / (behind + 1)), abs=3e-2)
    assert got[4]["pll"] == pytest.approx(plain(net, [r[b"w1"]]), abs=3e-2)
    assert got[5]["pll"] == pytest.approx(got[6]["pll"], abs=1e-3) and got[None]["pll"] == got[1]["pll"]


def test_probabilities_add_up_to_one():
    net = lm.Net.start(np.random.default_rng(2).integers(0, 90, lm.VOCAB))
    net.train(np.random.default_rng(3).integers(1, lm.VOCAB, (5000, 5)).astype(np.uint16))
    flat = np.tile(np.array([0, 0, 7, 0, 0], np.uint16), lm.VOCAB - 1)
    flat[2::5] = np.arange(1, lm.VOCAB)
    flat[1::5], flat[3::5] = 900, 33
    assert np.exp(net.rounded().log_probs(flat, np.arange(2, len(flat), 5))).sum() == pytest.approx(1, abs=1e-3)


def test_ids_are_distinct():
    every = [lm.own_id(k) for k in range(lm.FREQUENT)] + [lm.shared_id(b) for b in range(lm.SHARED)]
    assert sorted(every) == list(range(1, lm.VOCAB))


def test_both_sides_tell_order(make):
    docs = corpus(make, 4000)
    line = [f"w{k % 40}" for k in range(60)]
    mixed = random.Random(1).sample(line, 60)
    got = {x["doc_id"]: x for x in lm.score(make([(1, " ".join(line)), (2, " ".join(mixed))]), *lm.fit(docs)).collect()}
    assert got[1]["pll_per_token"] > got[2]["pll_per_token"] + 1.0


def test_texts_are_split_as_one_by_one():
    texts = [None, "", " ", " \t\n", "A\x0bB\x0cC\rD\nE\tF  g ", "\x1c a\x1d", "\x00 x\x00y", "ÀÉ Éa\u0085b c İ K", *(f"x{chr(k)}Y{chr(k)}" for k in range(256))]
    for some in (texts, texts[3:9], [None], []):
        words, n = lm.split(pa.array(["cut off", *some], pa.string()).slice(1))
        assert words.to_pylist() == [w for t in some for w in lm.words_of(t)] and n.tolist() == [len(lm.words_of(t)) for t in some]
        assert lm.buckets_of(words).tolist() == [lm.bucket_of(w) for w in words.to_pylist()]
    assert lm.buckets_of(words.slice(0, 0)).tolist() == [] and lm.buckets_of(pa.array([b"p", b"qq", b"r"]).slice(1)).tolist() == [lm.bucket_of(b"qq"), lm.bucket_of(b"r")]


def test_no_stretch_of_texts_is_much_longer_than_wanted(monkeypatch):
    monkeypatch.setattr(lm, "SPLIT", 10)
    texts = pa.array(["abc", None, "d" * 35, "", "e" * 9, "f", "g"])
    got = lm.stretches(texts)
    assert [k for a, n in got for k in range(a, a + n)] == list(range(7)) and len(got) > 2 and all(sum(len(t or "") for t in texts.slice(a + 1, n - 1).to_pylist()) < 10 for a, n in got)
    assert lm.stretches(texts.slice(0, 0)) == []


def test_blocks_tell_all_words(make, odd, monkeypatch):
    """In small blocks too, whatever the words are."""
    docs = odd.unionByName(corpus(make, 50))
    want = Counter((r["doc_id"], *lm.words_of(r["text"])) for r in docs.collect())
    for block, split in ((lm.BLOCK, lm.SPLIT), (200, 100)):
        monkeypatch.setattr(lm, "BLOCK", block)
        monkeypatch.setattr(lm, "SPLIT", split)
        got = Counter()
        for r in lm.numbered(docs.coalesce(1)).collect():
            words, numbers = [bytes(w) for w in r["words"]], np.frombuffer(r["numbers"], np.int32)
            assert len(set(words)) == len(words) and Counter(numbers.tolist()) == dict(enumerate(r["counts"])) and np.frombuffer(r["buckets"], np.int16).tolist() == [lm.bucket_of(w) for w in words]
            for key, a, n in zip(r["keys"], np.cumsum(r["n"]) - r["n"], r["n"], strict=True):
                got[key, *(words[k] for k in numbers[a : a + n])] += 1
        assert got == want


def test_logits_stay_in_a_cache_and_strips_change_nothing(monkeypatch):
    r = np.random.default_rng(4)
    rows = np.minimum(r.zipf(1.2, (20_000, 5)), lm.VOCAB - 1).astype(np.uint16)
    flat = np.concatenate([np.zeros(2, np.uint16), rows.ravel(), np.zeros(2, np.uint16)])
    sizes, log_of, slopes = [], lm.log_of, lm.slopes
    monkeypatch.setattr(lm, "log_of", lambda z, k: (sizes.append(z.nbytes), log_of(z, k))[1])
    monkeypatch.setattr(lm, "slopes", lambda z, *x: (sizes.append(z.nbytes), slopes(z, *x))[1])
    monkeypatch.setattr(lm, "STEPS", 5)
    nets, scores = [], []
    for chunk in (lm.CHUNK, 7, 8192):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        net = lm.Net.start()
        net.train(rows)
        nets.append(net.flat())
        scores.append(lm.Net.from_flat(nets[0]).rounded().log_probs(flat, np.flatnonzero(flat)))
        if chunk == 2048:
            assert max(sizes) <= 1 << 20
    assert np.abs(nets[0] - nets[1]).max() < 1e-2 and np.abs(nets[0] - nets[2]).max() < 1e-2
    assert (scores[0] == scores[1]).all() and (scores[0] == scores[2]).all()
