"""The pipeline's stages, each over what its predecessor kept, against plain computations."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_langid import text as words
from test_minhash import brute

from driftline.llm import queries
from driftline.llm.queries import tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(make):
    r = random.Random(3)
    rows = [(k, words(r, lang := ("aa", "bb", "cc")[k % 3], r.randint(20, 90)), lang, f"s{k % 4}") for k in range(150)]
    rows += [(200 + k, rows[k][1] + " ende", rows[k][2], "s1") for k in range(20)] + [(300 + k, rows[k][1], None, None) for k in range(10)]
    return make([*rows, (400, None, "aa", "s0"), (401, "123 !!!", "bb", "s0"), (402, "", None, "s2")])


def test_stages(spark, docs, tmp_path):
    kept = docs
    for name, stage in pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        rows, was = [r.asDict() for r in kept.collect()], [r.asDict() for r in before.collect()]
        if name == "language":
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in was if r["doc_id"] < 400)
        if name == "near_dedup":
            want = {c for _, c in brute([(r["doc_id"], r["text"]) for r in was], 5).values()}
            assert sorted(r["doc_id"] for r in rows) == sorted(want) and len(rows) < len(was)
        if name == "mixing":
            n = Counter(r["doc_id"] for r in rows)
            assert max(n.values()) <= 3 and set(n) <= {r["doc_id"] for r in was}
            size = lambda rs: sum(len(r["text"].split()) for r in rs)
            assert 0.97 * size(was) <= size(rows) <= size(was)
        if name == "encode":
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer_path())
            texts = Counter(hashlib.sha256(np.array(tok.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in was)
            assert Counter(r["ids_sha256"] for r in rows) == texts
            assert Counter(r["decoded_sha256"] for r in rows) == Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in was)


def test_columns_of_other_tables_come_through(spark, docs, tmp_path):
    more = docs.withColumns({c: docs.n_chars for c in ("_score", "_row", "doc", "row", "copy", "score", "lang_pred", "size", "times", "nth", "key", "node", "decoded", "ids")}).withColumn("size", docs.doc_id + 5)
    kept = more
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == more.columns and kept.where("size <> doc_id + 5").count() == 0
    assert pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == kept.count()


def test_an_empty_table_goes_through(spark, make, tmp_path):
    kept = make([])
    for name, stage in pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.count() == 0


def test_queries_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 13)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_near_dedup_keeps_one_row_a_group_whatever_its_doc_id(spark, make):
    r = random.Random(8)
    a, b, c, d, e, f = (words(r, "aa", 60) for _ in range(6))
    docs = make([
        (None, a), (None, b), (None, b), (None, c), (2, c), (5, d), (5, d), (6, e), (6, f), (3, f + " ende"), (7, None), (None, None),
    ])
    kept = dict(pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    want = [(None, a), (None, b), (2, c), (5, d), (6, e), (3, f + " ende"), (7, None), (None, None)]
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == Counter(want)
