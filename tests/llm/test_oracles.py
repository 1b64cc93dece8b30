"""Queries against their check SQL on DuckDB, value by value."""

import duckdb
import pytest

from barline.llm.queries import QUERIES, SQL


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, scale):
    folder = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want, got = con.sql(SQL[name]).to_arrow_table(), QUERIES[name](spark, folder).toArrow()
    assert rows(got) == rows(want)
    assert {f.name: str(f.type).replace("large_", "") for f in got.schema} == {f.name: str(f.type).replace("large_", "") for f in want.schema}
