"""Every query of the reference's part against its SQL, at the smallest size."""

import hashlib
import math
from pathlib import Path

import duckdb
import pytest

from driftline.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7) + 0.0
    return x


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert rows
        return
    r = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(x[c]) for c in sorted(names)) for x in rows), key=repr) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_incremental_append_delivers_every_draft_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    got = catalog.QUERIES["incremental_append"](spark, str(DATA)).first()
    assert got["first"] == got["rows"] > 10 and got["second"] == 0
    assert spark.read.parquet(f"{tmp_path}/incremental/in").count() == 2 * got["first"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["incremental_append", "jmq_recompute", "emb_cache_round"])
def test_a_query_gives_the_same_again_in_one_session(spark, name):
    first = catalog.QUERIES[name](spark, str(DATA))  # read only after the second one has run
    second = catalog.QUERIES[name](spark, str(DATA))
    rows = [sorted(map(repr, df.collect())) for df in (second, first)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_drafts_live_gives_every_text_and_seed(spark, duck):
    """Seeds by Python's hash, in the query and in its SQL."""
    df = catalog.QUERIES["drafts_live"](spark, str(DATA))
    assert df.columns == ["pair_id", "text", "seed"]
    got = {r["pair_id"]: (r["text"], r["seed"]) for r in df.collect()}
    assert got == {r[0]: r[1:] for r in duck.execute(catalog.ORACLE["drafts_live"]).fetchall()}
    prompts = {r["pair_id"]: r["prompt"] for r in catalog.b.pairs(spark, str(DATA)).collect()}
    assert got
    for pair, (text, seed) in got.items():
        want = int.from_bytes(hashlib.blake2b(f"{catalog.SEED}:{pair}".encode(), digest_size=8).digest(), "big") & 0xFFFFFFFF
        assert (text, seed) == (f"{prompts[pair]} [draft {want % 1000}]", want)
