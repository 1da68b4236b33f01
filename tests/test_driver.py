"""The driver contract: entry() runs, every query has an oracle, and each
query equals its DuckDB oracle on the smallest scale factor."""

import re
from collections import Counter

import pytest

import __spark_entry__ as E

D = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "digest" in df.columns


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    # the training-data operators that SQL cannot express have tests of their own
    own = {q for q in E.queries() if not re.match(r"op\d+_|pipeline$", q)}
    assert own <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    ocols = [x[0] for x in res.description]
    assert sorted(ocols) == cols
    want = Counter(tuple(norm(x[ocols.index(c)]) for c in cols) for x in res.fetchall())
    assert got == want
