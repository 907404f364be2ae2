"""The registered queries against their SQL where there is one, at the smallest size; the others give whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from driftline.llm import queries

DATA = Path("/root/testdata/sf0.001")
ROWS = {"op5_warc": "pages", "op6_embeddings": "embeddings", "op8_chat": None}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in queries.ORACLE:
        t = ROWS.get(name, "documents")
        assert len(rows) == c.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0]
        return
    r = c.execute(queries.ORACLE[name])
    names = [d[0] for d in r.description]
    plain = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 7) if isinstance(x, float) else x
    want = sorted((tuple(plain(x[names.index(n)]) for n in sorted(names)) for x in r.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(x[n]) for n in sorted(names)) for x in rows), key=repr) == want
