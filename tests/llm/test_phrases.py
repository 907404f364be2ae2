import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from driftline.llm import phrases


def counted(rows):
    """Counts of all phrases of one to four words by language, and of all words."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, least=30, share=80, top=2000):
    f, n = counted(rows)
    candidates = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    longer = Counter()
    for (g, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[g, p[i : i + size]] = max(longer[g, p[i : i + size]], a)
    out = {}
    for (g, p), a in candidates.items():
        if (g, p) in longer and 100 * longer[g, p] >= share * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((g, k + 1, p.decode(), -a, left, right, n[g], -s) for g, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def texts(seed=1, n=60, words=40):
    """Pieces over a small vocabulary, with ends, blanks and odd characters between."""
    r, own = random.Random(seed), ["a", "B", "c-d", "é", "日本", "Ab", "x1", "\x00", "longer" * 30, "\x85q"]
    return [("".join(r.choice(own) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; "]) for _ in range(r.randrange(words))), r.choice(["en", "de", "und", None, "x y"])) for _ in range(n)]


def nodes(rows, least, shards, bounds):
    """Merged nodes of texts dealt to shards, without Spark."""
    parts: dict[int, list[bytes]] = {}
    for k in range(shards):
        own = [(t or "", g or "und") for t, g in rows[k::shards]]
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in own], pa.string()), "lang": pa.array([g for _, g in own], pa.string())})
        for words in phrases.shards([batch]):
            for part, blob in phrases.Trie(words).segments(bounds) if words.n else ():
                parts.setdefault(part, []).append(blob)
    return [r for blobs in parts.values() if (b := phrases.merged(blobs, least)) is not None for r in b.to_pylist()]


@pytest.mark.parametrize("shards", [1, 3, 7])
@pytest.mark.parametrize("cuts", [0, 1, 5, 40])
def test_merged_tries_hold_every_frequent_phrase_once_wherever_the_bounds_are(shards, cuts):
    rows, least = texts(), 3
    f, n = counted(rows)
    paths = sorted({(g.encode(), *(w.encode() for w in p)) for g, p in f} | {(b"zz",), (b"en", b"zz", b"q"), (b"", b"a")})
    bounds = sorted(random.Random(cuts).sample(paths, cuts))
    got = nodes(rows, least, shards, bounds)
    want = {(g, " ".join(p)): (len(p), a, n[g], [f[g, p[:k]] for k in range(1, len(p))]) for (g, p), a in f.items() if a >= least}
    assert len(got) == len(want) > 50
    assert {(r["lang"], r["phrase"]): (r["m"], r["a"], r["n"], r["lefts"]) for r in got} == want


def tuples(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_against_a_plain_count(spark, make):
    rows = texts(2, 300)
    docs = make([(k, t, g) for k, (t, g) in enumerate(rows)]).repartition(5)
    assert tuples(phrases.collocations(docs, least=4, top=25)) == brute(rows, 4, 80, 25)
    assert tuples(phrases.collocations(docs, least=30, share=50)) == brute(rows, 30, 50)


def test_odd_texts_clashing_columns_and_copies(spark, odd, make):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    more = odd.selectExpr("*", "1 AS n", "2 AS m", "'x' AS part", "3 AS phrase", "4 AS rank", "5 AS a", "6 AS segment", "7 AS _rest")
    assert tuples(phrases.collocations(more, least=2)) == brute(rows, 2)
    hot = [("one hot passage that all have, and more", "en")] * 400 + [("all have it", None)] * 30
    got = tuples(phrases.collocations(make([(None, *r) for r in hot]), least=30))
    assert got == brute(hot)
    assert {r[0] for r in got} == {"en", "und"}


def test_ties_of_cuts_go_to_the_first_and_of_phrases_to_their_bytes(spark, make):
    rows = [("p q", "en"), ("é y", "en"), ("Z z2", "en")] * 30
    got = tuples(phrases.collocations(make([(k, *r) for k, r in enumerate(rows)])))
    assert [r[2] for r in got] == ["p q", "z z2", "é y"]
    assert {r[7] for r in got} == {1_000_000}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " .;\n"), (3, "too rare")]])
def test_without_frequent_phrases_there_are_no_rows(spark, make, rows):
    out = phrases.collocations(make(rows))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert out.collect() == []
