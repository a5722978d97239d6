"""Queries of the training-data operators that have SQL, on whole tables and on odd rows."""

import duckdb
import pytest

from lodestone.llm.queries import QUERIES, SQL


def by_sql(path, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}')")
    cursor = con.execute(SQL[name])
    return sorted(d[0] for d in cursor.description), sorted(cursor.fetchall()), [d[0] for d in cursor.description]


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("table", ["whole", "odd"])
def test_equals_sql(spark, plain, tmp_path, name, table):
    folder = "/root/testdata/sf0.001"
    if table == "odd":
        folder = str(tmp_path)
        plain.toPandas().to_parquet(f"{folder}/documents.parquet")
    names, want, order = by_sql(f"{folder}/documents.parquet", name)
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == want
