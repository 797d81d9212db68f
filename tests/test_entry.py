import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from meterlake.plans.oracles import ORACLES
from meterlake.plans.queries import QUERIES
from tests.conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number)):
        return round(float(v), 6)
    return str(v)[:26].removesuffix(" 00:00:00")


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, row)) for row in frame.itertuples(index=False)), key=str)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_oracle(spark, other, name):
    got, expect = QUERIES[name](spark, TINY).toPandas(), other.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expect.columns)
    assert plain(got) == plain(expect)


@pytest.fixture(scope="module")
def clashing(tmp_path_factory):
    """A folder whose events come three times under other numbers: records with one business key differ in their measures."""
    folder, con = tmp_path_factory.mktemp("clashing"), duckdb.connect()
    for t in ("region", "nation", "customer"):
        os.symlink(f"{TINY}/{t}.parquet", folder / f"{t}.parquet")
    con.execute(f"COPY (SELECT * REPLACE (event_id + i * (SELECT max(event_id) + 1 FROM '{TINY}/events.parquet') AS event_id) FROM '{TINY}/events.parquet', range(3) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
    for t in ("region", "nation", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["stream_clean", "stream_rollup_5min"])
def test_records_that_share_a_key_and_differ_agree_with_the_oracle(spark, clashing, name):
    folder, con = clashing
    got, expect = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert plain(got) == plain(expect)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_the_rest_imports_without_the_subpackage(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for name in ("meterlake", "__spark_entry__.py"):
        os.symlink(root / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "meterlake").mkdir()
    for part in (root / "meterlake").iterdir():
        if part.name not in ("llm", "__pycache__"):
            os.symlink(part, tmp_path / "meterlake" / part.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q1_top_energy_assets' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
