"""Recordings of no length (the tables up to sf0.01 have none) against the SQL."""

import pytest

from oracle import same, tables
from tidewave.plans import queries as q

NAMES = ["remove_overlaps", "drop_empty_segments", "fill_gaps", "kept_per_station", "populated_ratio", "remove_empty_sides", "segments_files", "window_items"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("no_length"))
    own = tables("/root/testdata/sf0.001")
    # some without a length, and some of these where the recording before ends
    own.sql(f"COPY (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS value, props FROM events UNION ALL SELECT 1000000 + event_id, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), user_id, event_type, 0.0, props FROM events WHERE event_id % 5 = 0) TO '{path}/events.parquet'")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, name):
    same(q.QUERIES[name](spark, folder), q.ORACLES[name], folder)
