"""Event queries against DuckDB on values that the given tables lack."""

import duckdb
import pytest

from larkspan.plans.registry import QUERIES, SQL

NAMES = ["frame_spine", "neighbour_parts", "spread_parts", "sparse_detect", "detect_values", "directed_dilation", "edge_patches", "padded_examples"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Events with values of six hundreds and more, below zero and null, and with null times and types."""
    d = tmp_path_factory.mktemp("odd")
    duckdb.sql(f"""COPY (SELECT event_id, CASE WHEN event_id % 37 <> 0 THEN ts END AS ts, user_id, CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type,
CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -value WHEN event_id % 5 = 0 THEN value * 7 ELSE value END AS value FROM '/root/testdata/sf0.001/events.parquet') TO '{d}/events.parquet'""")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_on_odd_values(spark, odd, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{odd}/events.parquet'")
    frame = QUERIES[name](spark, str(odd))
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, db.sql(SQL[name]).select(*frame.columns).fetchall()))
