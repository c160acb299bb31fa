from pathlib import Path

import duckdb
import pytest
from conftest import rows

from terrane.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    out = rows(got)
    if name.endswith("_found"):
        assert len(out) == len(set(out)) > 0
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("commits", "documents", "mix_targets", "size_limits"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        assert out == sorted(con.execute(queries.ORACLE[name]).fetchall(), key=repr)
