import os

import duckdb
import pytest

from votewright.llm import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "embeddings"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
        found = db.sql(registry.oracle_sql()[name])
        columns = sorted(found.columns)
        want = sorted(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, SMALL).collect())
    assert got == want and want
