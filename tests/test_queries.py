"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenlog import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF)
    got = rows(found.columns, found.collect())
    if name not in queries.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(c[0] for c in result.description)
    assert got == rows([c[0] for c in result.description], result.fetchall())
