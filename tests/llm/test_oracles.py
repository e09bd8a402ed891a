import os

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import canonical

SF = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(cols, cur.fetchall())
