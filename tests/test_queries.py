"""Every query against its SQL in DuckDB at sf0.001."""

import duckdb
import pytest

from marklens.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row):
    return tuple(("",) if v is None else ("n", float(v)) if isinstance(v, (int, float)) else (type(v).__name__, v) for v in row)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    want = sorted(duck.sql("select " + ",".join(f'"{c}"' for c in cols) + f" from ({registry.oracle_sql()[name]})").fetchall(), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-4) for x, y in zip(a, b))
