"""The jobs as queries against their SQL, and what they leave behind."""

import math
from pathlib import Path

import duckdb
import pytest

from jobs import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    plain = lambda x: round(x, 7) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    first, second = (queries.QUERIES[name](spark, str(DATA)) for _ in range(2))
    r = c.execute(queries.ORACLE[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(n)]) for n in sorted(names)) for x in r.fetchall()), key=repr)
    for df in (second, first):  # a later call leaves an earlier one's output alone
        assert sorted(df.columns) == sorted(names)
        assert sorted((tuple(plain(x[n]) for n in sorted(names)) for x in df.collect()), key=repr) == want and want
