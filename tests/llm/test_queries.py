import os

import duckdb
import pytest

from flowgauge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_one_row_each(spark, name):
    df = queries.queries()[name](spark, SF)
    key = "conv_id" if name.startswith("op1_") else "doc_id"
    table = spark.read.parquet(f"{SF}/{'conversations' if key == 'conv_id' else 'documents'}.parquet")
    assert sorted(r[key] for r in df.collect()) == sorted(r[key] for r in table.select(key).distinct().collect()) if key == "doc_id" else df.count() == table.select(key).distinct().count() + 1
