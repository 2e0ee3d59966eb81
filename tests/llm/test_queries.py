"""The queries with SQL give the SQL's rows; the others have a row for each row of their table."""

import os

import duckdb
import pytest

from arraylens.llm.queries import ORACLE, QUERIES

AT = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    got = QUERIES[name](spark, AT)
    order = sorted(got.columns)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == order
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(tuple(r[names.index(c)] for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    rows = "conversations" if name == "op2_quote_linking" else "documents"
    assert QUERIES[name](spark, AT).count() == spark.read.parquet(f"{AT}/{rows}.parquet").count()
