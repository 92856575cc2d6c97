import duckdb
import pytest
from tessera.llm import suite

from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    want = con.execute(suite.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = suite.QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in suite.QUERIES) == list(range(1, 14))
