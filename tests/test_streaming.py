"""Streamed sessions against batch ones: typed state over micro-batches, ties, drains, late and repeated rows."""

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import sessions
from sessionlens.plans import catalog
from sessionlens.sources import demo_tables
from sessionlens.sources.flow_events import normalise
from sessionlens.streaming import intake
from sessionlens.streaming import sessions as stream

from .helpers import spark_rows

G = 1_000_000_000


def events(spark, rows):
    """rows: seq, seconds, port, type, sizes, gaps."""
    df = spark.createDataFrame([(q, int(s * G), p, t, sizes, gaps, 10 * q, "fin" if t == "CLOSE" else "") for q, s, p, t, sizes, gaps in rows], "seq long, timestamp_ns long, src_port int, event_type string, packet_sizes array<long>, iat_us array<long>, bytes_sent long, close_reason string")
    return normalise(df.withColumns({"src_ip": F.lit("10.0.0.1"), "dst_ip": F.lit("10.0.0.2"), "dst_port": F.lit(443), "node_name": F.lit("n")}), decode_tls=False)


def run(spark, folder, schema, drain=False, **more):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    if drain:
        spark.createDataFrame([(drain * G,)], "flush_ns long").write.mode("append").parquet(f"{folder}/drain")
    else:
        spark.createDataFrame([], "flush_ns long").write.mode("append").parquet(f"{folder}/drain")
    drains = stream.drain_rows(spark.readStream.schema("flush_ns long").parquet(f"{folder}/drain")).withColumn("seq", F.lit(0).cast("long"))
    out = stream.streaming_sessions(source.unionByName(drains, allowMissingColumns=True), **more)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def comparable(df):
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array")) else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


@pytest.fixture(scope="module")
def streamed(spark, small):
    return catalog.streamed(spark, small)


def test_all_columns_equal_batch(spark, small, streamed):
    """Closed sessions, sessions that a drain ends, and windows: every column that batch has but session_no."""
    own = demo_tables.flow_events(spark, small)
    batch = sessions.sessions(own, long_lived_ns=catalog.LONG, flush_ns=catalog.FLUSH).drop("session_no")
    assert set(batch.columns) == set(streamed.columns)
    ended = streamed.where("record_type = 'session_summary'").select(*batch.columns)
    approx = lambda df: comparable(df.withColumn("iat_std", F.round(F.col("iat_std") / 1e6, 3)))
    assert spark_rows(approx(ended)) == spark_rows(approx(batch))
    windows = sessions.window_summaries(own, window_ns=catalog.DAY, long_lived_ns=catalog.LONG).drop("session_no")
    assert spark_rows(approx(streamed.where("record_type = 'window_summary'").select(*windows.columns))) == spark_rows(approx(windows))


def test_state_across_batches_ties_and_timeouts(spark, tmp_path):
    """One file a micro-batch: equal times keep the order of seq; a session times out by the watermark, a drain ends the rest."""
    files = [
        [(2, 10, 1, "STATS", [5, 700], []), (1, 10, 1, "CONNECT", [2000], [50]), (3, 11, 2, "CONNECT", [], [])],
        [(4, 12, 1, "STATS", [9], [2_000_000]), (6, 13, 1, "CLOSE", [1], []), (5, 13, 1, "STATS", [3], [7]), (7, 13, 1, "STATS", [4], [])],
        [(8, 500, 3, "CONNECT", [1], []), (9, 520, 3, "STATS", [2], [])],
    ]
    folder = str(tmp_path)
    for rows in files:
        df = events(spark, rows).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in")
    out = run(spark, folder, df.schema, session_timeout_ns=60 * G, watermark="10 seconds")
    got = {(r.src_port, r.start_ns // G): r for r in out.collect()}
    assert (got[1, 10].event_count, got[1, 10].close_reason, got[1, 10].pkt_size_p50, got[1, 10].bytes_out, got[1, 10].node_name) == (5, "fin", 7.0, 60, "n")
    assert (got[2, 11].close_reason, got[2, 11].end_ns, got[1, 13].event_count) == ("timeout", 11 * G, 1) and len(got) == 3
    out = run(spark, folder, df.schema, drain=550, session_timeout_ns=60 * G, watermark="10 seconds")
    last = [r for r in out.collect() if r.src_port == 3]
    assert [(r.end_ns, r.duration_ms, r.event_count, r.close_reason) for r in last] == [(550 * G, 50_000, 2, "timeout")]


def test_reported_histograms_and_their_other_labels(spark, tmp_path):
    """Estimates come from reported buckets; a label that is none is kept, over micro-batches as in batch."""
    folder = str(tmp_path)
    base = events(spark, [(1, 10, 1, "CONNECT", [], []), (2, 11, 1, "STATS", [], []), (3, 12, 1, "CLOSE", [], [])])
    labelled = base.withColumn("packet_size_histogram", F.create_map(F.lit("64-127"), F.col("seq"), F.lit("jumbo"), F.lit(2).cast("long")))
    for k in (1, 2, 3):
        labelled.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = run(spark, folder, labelled.schema, watermark="1 hour", session_timeout_ns=3600 * G)
    batch = sessions.sessions(labelled).drop("session_no")
    assert spark_rows(comparable(out.select(*batch.columns))) == spark_rows(comparable(batch))
    h = batch.first().pkt_size_histogram
    assert (h["64-127"], h["jumbo"], len(h)) == (6, 6, 8)


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    folder = str(tmp_path)
    for rows in ([(1, 100, 1, "CONNECT", [], []), (2, 20, 2, "CONNECT", [], [])], [(3, 95, 1, "STATS", [], []), (4, 80, 2, "STATS", [], []), (5, 300, 1, "CLOSE", [], [])], [(6, 289, 2, "CLOSE", [], []), (7, 291, 2, "CLOSE", [], [])]):
        df = events(spark, rows).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in")
        intake.accept(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), folder, 10 * G).awaitTermination()
    assert sorted((r.seq, r.batch) for r in intake.late(spark, folder).collect()) == [(4, 1), (6, 2)]
    out = stream.streaming_sessions(intake.accepted(spark, folder, df.schema), watermark="10 seconds", session_timeout_ns=10_000 * G)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.src_port, r.event_count) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").where("record_type = 'session_summary'").collect()) == [(1, 3), (2, 2)]


def test_repeated_rows_count_once(spark, tmp_path):
    folder = str(tmp_path)
    for rows in ([(1, 100, 1, "CONNECT", [1], []), (1, 100, 1, "CONNECT", [1], [])], [(1, 100, 1, "CONNECT", [1], []), (2, 101, 1, "CLOSE", [2], [])]):
        df = events(spark, rows).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in")
    out = run(spark, folder, df.schema, watermark="10 seconds", unique=["src_port", "seq"])
    assert [(r.event_count, r.pkt_size_mean) for r in out.collect()] == [(2, 1.5)]


def test_ranges_are_in_order_of_their_values():
    values = [*range(-300, 5000), 2**20 - 1, 2**20, 2**40, 2**40 + 2**34, 2**40 + 2**36]
    ranges = [stream.value_range(v) for v in values]
    assert ranges == sorted(ranges) and len(set(ranges)) > 300


def test_counters_of_a_stream_equal_those_of_its_records(spark, tmp_path):
    """By the listener and by the query's progress, over several micro-batches; the gauge is what the state holds."""
    from sessionlens.streaming import metrics as live

    folder, counters = str(tmp_path), live.Counters()
    for rows in ([(1, 100, 1, "CONNECT", [], []), (2, 101, 2, "STATS", [], [])], [(3, 102, 1, "CLOSE", [], []), (4, 103, 3, "CONNECT", [], [])], [(5, 104, 3, "CLOSE", [], [])]):
        df = events(spark, rows).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = stream.streaming_sessions(live.observed_events(source), watermark="1 hour", session_timeout_ns=3600 * G)
    judged = out.withColumns({"src_mapping_confidence": F.when(F.col("src_port") == 1, "unknown").otherwise("high"), "dst_mapping_confidence": F.lit("low"), "dst_external": F.lit(True), "review_required": F.col("src_port") == 3})
    spark.streams.addListener(counters)
    try:
        q = live.observed(judged).select("flow_id").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if counters.finished:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    want = {"emitted": 2, "unknown_src": 1, "unknown_dst": 0, "external_dst": 2, "reviews": 1}
    assert live.totals(q.recentProgress, "records") == want == counters.value("records")
    assert live.totals(q.recentProgress, "events") == {"CONNECT": 2, "ACCEPT": 0, "STATS": 1, "CLOSE": 2, "TLS_HANDSHAKE": 0, "DROP": 0, "dropped": 0}
    assert live.open_sessions(spark, f"{folder}/state") == 1
