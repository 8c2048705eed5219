from pathlib import Path

import duckdb
import pytest

from lumenlog.llm import queries

from ..test_queries import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, result.fetchall())
