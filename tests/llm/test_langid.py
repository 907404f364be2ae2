import random

from driftline.llm import langid
from driftline.llm.queries import held_out

SYLLABLES = {"aa": ["ka", "to", "mi", "ro"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["éa", "oux", "ié", "ment"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(2, 4))) for _ in range(n)) + "."


def corpus(make, n=240):
    r = random.Random(0)
    return make([(k, text(r, (lang := ("aa", "bb", "cc")[k % 3]), r.randint(4, 60)), lang) for k in range(n)])


def test_held_out_accuracy_and_independence_of_labels(make):
    docs = corpus(make)
    names, protos = langid.train(docs.where(~held_out()))
    assert names == ["aa", "bb", "cc"]
    got = langid.predict(docs.withColumn("held", held_out()), names, protos).where("held").collect()
    assert len(got) > 40 and all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)
    plain = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.select("doc_id", "text"), names, protos).collect()}
    assert all(plain[r["doc_id"]] == r["lang_pred"] for r in got)


def test_odd_rows(make, odd):
    names, protos = langid.train(corpus(make, 60))
    got = langid.predict(odd.select("*", odd.doc_id.alias("score")), names, protos).collect()
    assert len(got) == odd.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0)
    assert langid.predict(odd.limit(0), names, protos).collect() == []


def test_no_labels(make, odd):
    names, protos = langid.train(odd)
    assert names == []
    assert {r["lang_pred"] for r in langid.predict(odd, names, protos).collect()} == {"und"}


def test_a_bounded_sample_still_learns(make):
    docs = corpus(make, 300)
    names, protos = langid.train(docs, rows=20)
    got = langid.predict(docs, names, protos).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)


def test_limits_tell_unlearned_languages_by_length(spark, make):
    from driftline.llm import stages

    r = random.Random(6)
    other = lambda n: " ".join("".join(r.choice("жщыфцэюя") for _ in range(6)) for _ in range(n))
    near = lambda n: " ".join("".join(r.choice(["zyx", "qwo", "vub", "xij"]) for _ in range(2)) for _ in range(n))
    docs = make(
        [(k, text(r, (lang := ("aa", "bb", "cc")[k % 3]), r.randint(20, 200)), lang) for k in range(400)]
        + [(1000 + k, other(300)) for k in range(20)] + [(2000 + k, near(300)) for k in range(20)]
        + [(3000 + k, text(r, ("aa", "bb", "cc")[k % 3], 120)) for k in range(60)] + [(4000, "12 !?"), (4001, None), (4002, "kato")]
    )
    kept = {x["doc_id"] for x in stages.language(spark, docs, "").collect()}
    assert {k for k in kept if k < 1000} == set(range(400)) and {k for k in kept if 3000 <= k < 4000} == set(range(3000, 3060))
    assert not {k for k in kept if 1000 <= k < 3000} and 4000 not in kept and 4001 not in kept and 4002 in kept


def test_profiles_are_those_of_a_plain_loop(make):
    """n-grams one by one, each letter's vector rotated by its place, products added up, cosines with the mean of the texts' directions."""
    import math

    docs = corpus(make, 45)
    names, protos = langid.train(docs)
    table = langid.letters(langid.DIM, langid.SEED)

    def bundle(t):
        out = [0.0] * langid.DIM
        slot = [int(langid.slots()[ord(c)]) for c in t.lower()]
        marks = [0]
        for x in slot:
            if x or marks[-1]:
                marks.append(x)
        marks.append(0)
        for k in range(1, len(marks) - 1):
            if marks[k]:
                a, b, c = (table[p][marks[k - 1 + p]] for p in range(3))
                for d in range(langid.DIM):
                    out[d] += float(a[d]) * float(b[d]) * float(c[d])
        return out

    norm = lambda v: math.sqrt(sum(x * x for x in v))
    means = {}
    for r in docs.collect():
        v = bundle(r["text"])
        m = means.setdefault(r["lang"], [0.0] * langid.DIM)
        for d in range(langid.DIM):
            m[d] += v[d] / norm(v)
    some = docs.limit(6)
    got = {r["doc_id"]: r for r in langid.predict(some, names, protos).collect()}
    for r in some.collect():
        v = bundle(r["text"])
        cos = {k: sum(x * y for x, y in zip(v, m, strict=True)) / norm(v) / norm(m) for k, m in means.items()}
        best = max(sorted(cos), key=cos.get)
        assert got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - cos[best]) < 1e-4


def test_every_labelled_row_counts(spark, make):
    """Of thousands of rows of a language, more than once were read, the few that are unlike the others move both the prototype and the limits."""
    r = random.Random(11)
    rows = [(k, "kato miro", "aa") for k in range(3500)]
    odd_ones = [(10_000 + k, text(r, "bb", 2), "aa") for k in range(1500)]
    docs = make(rows + odd_ones).repartition(3)
    names, protos = langid.train(docs)
    bundles = [langid.Profiler().bundles([x[1]])[0] for x in [rows[0], *odd_ones]]
    one = [v / langid.np.linalg.norm(v) for v in bundles]
    want = 3500 * one[0].astype(float) + sum(v.astype(float) for v in one[1:])
    assert names == ["aa"] and abs(protos[0] - want / langid.np.linalg.norm(want)).max() < 1e-5
    assert (langid.train(docs.repartition(7))[1] == protos).all()
    least = langid.limits(docs, names, protos)
    scores = langid.predict(docs, names, protos).groupBy(langid.size_class(langid.F.col("text")).alias("c")).agg(langid.F.count("*").alias("n"), langid.F.avg("score").alias("m"), langid.F.stddev_pop("score").alias("d")).collect()
    assert sum(x["n"] for x in scores) == 5000
    for x in scores:
        if x["n"] >= langid.LEAST_ROWS:
            assert abs(least[x["c"]] - max(0.0, x["m"] - langid.DEVIATIONS * x["d"])) < 1e-9
