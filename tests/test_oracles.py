"""Every registered query of the core library against its SQL, as sorted rows."""

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    try:
        return str(int(value)) if not isinstance(value, (str, bool)) and value == int(value) else str(value)
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    result = sql.execute(ORACLES[name])
    own = [c[0] for c in result.description]
    assert sorted(own) == columns
    assert got == sorted(tuple(plain(r[own.index(c)]) for c in columns) for r in result.fetchall())


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
