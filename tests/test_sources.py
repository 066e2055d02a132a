"""Streams, binary captures, labels and the sink of a stream."""

import json
import os

from pyspark.sql import functions as F

from sessionlens.operators import packets
from sessionlens.plans.catalog import client_hello_bytes
from sessionlens.plans.ledger import stream_ledger
from sessionlens.sources import flow_events as src
from sessionlens.streaming.sessions import streaming_sessions

from .test_sessions import G, flow, replay


def test_percentiles_of_long_sessions_are_exact(spark, tmp_path):
    at, n = 1_700_000_000 * G, 12_001
    key = {"src_ip": "10.0.0.1", "src_port": 1, "dst_ip": "10.0.0.2", "dst_port": 2, "protocol": "TCP"}
    rows = [key | {"event_type": "CONNECT", "timestamp_ns": at, "packet_sizes": list(range(n)), "iat_us": [7 * k for k in range(n)]}, key | {"event_type": "CLOSE", "timestamp_ns": at + G, "packet_sizes": [], "iat_us": []}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.jsonl").write_text("\n".join(map(json.dumps, rows)))
    events = src.normalise(src.stream_jsonl(spark, str(tmp_path / "in"), max_files=1))
    query = streaming_sessions(events).writeStream.format("memory").queryName("long_sessions").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    (got,) = spark.table("long_sessions").where("record_type = 'session_summary'").collect()
    assert (got.pkt_size_p50, got.pkt_size_p95, got.iat_p50, got.iat_p95) == (6000.0, 11400.0, 42000.0, 79800.0)


def test_stream_of_files(spark, tmp_path):
    """One batch per file: sessions of the replay, a hello in between, and a session that times out when time moves on."""
    (tmp_path / "in").mkdir()
    rows = replay()
    rows.append(flow(9, "10.9.9.9", 1, "10.9.9.8", 2, 1002, "CONNECT"))
    rows += [flow(8, "10.9.9.9", 7, "10.9.9.8", 2, at, "STATS") for at in (5000, 5001)]
    for k, part in enumerate((rows[:9], rows[9:-2], rows[-2:-1], rows[-1:])):
        file = tmp_path / "in" / f"{k}.jsonl"
        file.write_text("\n".join(json.dumps(x) for x in part))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
    events = src.normalise(src.stream_jsonl(spark, str(tmp_path / "in"), max_files=1))
    query = stream_ledger(streaming_sessions(events, session_timeout_ns=60 * G, watermark="1 second"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = [json.loads(x) for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()]
    closed = {x["flow_id"][:8]: x for x in out if x["record_type"] == "session_summary"}
    assert {"190f1295", "0bee4ac3", "5fd01365", "6b71fa34", "b4a831c1"} <= set(closed)
    one, three = closed["190f1295"], closed["5fd01365"]
    assert (one["close_reason"], one["bytes_in"], one["idle_gap_count"], one["burst_count"], one["pkt_size_p50"]) == ("fin", 4096, 2, 3, 383.5)
    assert three["ja4s"] == "t1201h2_c02f_0b08e3dcc50f" and three["handshake_seen"] and three["pkt_size_p95"] == 1428.6
    assert [x["src_ip"] for x in out if x["close_reason"] == "timeout"].count("10.9.9.9") == 1
    assert [(x["flow_id"][:8], x["window_id"]) for x in out if x["record_type"] == "window_summary"] == [("2a4183e4", 1)]


def test_captures(spark):
    hello = client_hello_bytes("example.com", [0x1301], [0x0000, 0x0010], "h2", [], [])
    head = lambda direction, n: (7 * G).to_bytes(8, "little") + (3).to_bytes(8, "little") * 2 + direction.to_bytes(4, "little") + bytes([10, 0, 0, 1]) + bytes([10, 0, 0, 2]) + (1000).to_bytes(2, "little") + (443).to_bytes(2, "little") + n.to_bytes(4, "little")
    rows = [(head(1, len(hello)) + hello,), (head(2, len(hello)) + hello,), (head(1, 20) + hello,), (b"short",), (None,)]
    got = src.normalise(src.captures(spark.createDataFrame(rows, "record binary"))).orderBy("tls_parse_status", "tls_server_parse_status").collect()
    assert len(got) == 3 and {(r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol) for r in got} == {("10.0.0.1", 1000, "10.0.0.2", 443, "tcp")}
    assert sorted((r.tls_parse_status, r.tls_server_parse_status) for r in got) == [("", "not_serverhello"), ("fragmented", ""), ("parsed", "")]
    assert all(r.tls_payload_hex == "" for r in got)


def test_labels_keep_the_last_good_read(spark):
    rows = [(1, False, "", ""), (2, True, "e1", "s"), (3, False, "", ""), (4, True, "", "t")]
    reads = spark.createDataFrame(rows, "read_at int, ok boolean, experiment_id string, scenario_label string").withColumns({c: F.lit("") for c in ("scenario_phase", "attack_enabled", "load_level")})
    got = [(r.experiment_id, r.scenario_label) for r in src.current_labels(reads).orderBy("read_at").collect()]
    assert got == [("unknown", "unlabeled"), ("e1", "s"), ("e1", "s"), ("unknown", "t")]


def test_switches_and_state_changes(spark):
    e = src.normalise(spark.createDataFrame([([1], [2], 3)], "packet_sizes array<bigint>, iat_us array<bigint>, timestamp_ns long"))
    (r,) = src.without_features(e, sizes=False).collect()
    assert r.packet_sizes == [] and r.iat_us == [2] and r.pkt_size_min is None
    changes = spark.createDataFrame([(1, "ESTABLISHED", 5), (2, "CLOSE", 9), (3, "OTHER", 9)], "k int, state string, bytes_sent long")
    got = [(r.event_type, r.bytes_sent, r.syn_count, r.fin_count) for r in packets.state_events(changes).orderBy("k").collect()]
    assert got == [("CONNECT", 0, 1, 0), ("CLOSE", 9, 0, 1)]


def test_both_ways_share_a_key(spark):
    p = spark.createDataFrame([("a", 1, "b", 2, False), ("b", 2, "a", 1, True)], "src_ip string, src_port int, dst_ip string, dst_port int, ingress boolean")
    assert {(r.src_ip, r.src_port, r.dst_ip, r.dst_port) for r in packets.both_ways_key(p, F.col("ingress")).collect()} == {("a", 1, "b", 2)}
