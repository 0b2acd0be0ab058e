"""The operators' SQL on the smallest tables."""

import duckdb
import pytest

from lumenline.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    found = con.execute(registry.ORACLE_SQL[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in order)) for r in df.collect())
