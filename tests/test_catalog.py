import os

import duckdb
import pytest

from sessionlens.plans import catalog

from .helpers import TABLES, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    assert spark_rows(catalog.QUERIES[name](spark, small)) == duck_rows(catalog.ORACLE_SQL[name], small)


def test_streaming_closes_what_batch_closes(spark, small):
    from sessionlens.operators import sessions
    from sessionlens.sources import demo_tables

    columns = ["src_port", "flow_id", "start_ns", "end_ns", "event_count", "bytes_out", "syn_count", "idle_gap_count", "burst_count", "pkt_size_p50", "iat_p95"]
    streamed = catalog.streaming_sessions(spark, small)
    closed = streamed.where("record_type = 'session_summary' AND close_reason <> 'timeout'").select(*columns)
    batch = sessions.sessions(demo_tables.flow_events(spark, small), long_lived_ns=catalog.LONG).where("closed = 1").select(*columns)
    assert spark_rows(closed) == spark_rows(batch)
    windows = streamed.where("record_type = 'window_summary'").select("src_port", "window_id", "end_ns", "event_count")
    own = sessions.window_summaries(demo_tables.flow_events(spark, small), window_ns=catalog.DAY).selectExpr("src_port", "cast(window_id as long) window_id", "end_ns", "event_count")
    assert spark_rows(windows) == spark_rows(own)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def grown(small, tmp_path_factory):
    """The events, customers and suppliers of 21 small tables with shifted keys: event ids in the millions, users beyond two bytes, several pods of an address."""
    folder = tmp_path_factory.mktemp("grown")
    shifted = {"events": "event_id + i * 300000 AS event_id, user_id + CASE WHEN i = 20 THEN 90000 ELSE i * 15 END AS user_id", "customer": "c_custkey + i * 150 AS c_custkey, 'Customer#' || (c_custkey + i * 150) AS c_name", "supplier": "s_suppkey + i * 10 AS s_suppkey, 'Supplier#' || (s_suppkey + i * 10) AS s_name"}
    for t in TABLES:
        if t in shifted:
            duckdb.sql(f"COPY (SELECT * REPLACE ({shifted[t]}) FROM '{small}/{t}.parquet', (SELECT range AS i FROM range(21))) TO '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{small}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["record_time_format", "binary_flow_records", "identity_source", "kernel_row_decode", "metrics_rollup", "reason_codes"])
def test_query_equals_sql_on_larger_keys(spark, grown, name):
    assert spark_rows(catalog.QUERIES[name](spark, grown)) == duck_rows(catalog.ORACLE_SQL[name], grown)
