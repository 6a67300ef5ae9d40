from pathlib import Path

import duckdb
import pytest

from evidenceloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_a_row_for_each_document(spark, name):
    df = queries.queries()[name](spark, SF)
    table = "conversations" if name.startswith("op9") else "documents"
    assert df.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
