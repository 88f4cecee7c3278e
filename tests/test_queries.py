"""Every query with SQL against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

from larkspan.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(SQL[name]).df())
