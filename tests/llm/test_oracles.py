import duckdb
import pytest

from meterlake.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.test_entry import TABLES, plain


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, expect = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expect.columns)
    assert plain(got) == plain(expect)
