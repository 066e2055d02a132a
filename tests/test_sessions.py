"""Replay of six small flows, scenarios of single keys."""

import json

import pytest

from sessionlens import schema as S
from sessionlens.operators import identity, sessions
from sessionlens.plans import ledger
from sessionlens.sources import flow_events as src

G = 1_000_000_000


def flow(n, ip, port, dst, dport, at, kind, **more):
    return {"timestamp_ns": int(at * G), "event_type": kind, "cgroup_id": n, "netns_ino": 1, "src_ip": ip, "src_port": port, "dst_ip": dst, "dst_port": dport, "protocol": "tcp"} | more


# Events of the replay and the ids that sessions of them have.
def replay():
    sizes = ["0-63", "64-127", "128-255", "256-511", "512-1023", "1024-1500", ">1500"]
    iats = ["<100", "100-1000", "1000-10000", "10000-100000", "100000-1000000", ">1000000"]
    a, b, c = ("10.244.1.10", 43120, "10.244.1.20", 8080), ("10.244.2.10", 43200, "10.244.3.10", 5432), ("10.244.1.10", 43300, "93.184.216.34", 443)
    d, e, f = ("10.244.9.99", 43400, "10.244.1.20", 8080), ("10.244.1.10", 43500, "10.244.1.20", 8080), ("10.244.1.10", 43600, "10.244.1.20", 8080)
    last = {"bytes_sent": 1500, "bytes_recv": 500, "packets_sent": 3, "packets_recv": 2}
    server = {"direction": 2, "server_hello_seen": True, "tls_version_negotiated": "1.2", "alpn_negotiated": "h2", "ja4s": "t1201h2_c02f_0b08e3dcc50f", "tls_server_parse_status": "parsed"}
    return [
        flow(1, *a, 100, "CONNECT", tcp_state="established"),
        flow(1, *a, 101, "STATS", bytes_sent=512, bytes_recv=2048, packets_sent=5, packets_recv=8, packet_sizes=[60, 120, 256, 900, 1400], iat_us=[100, 1500, 12000, 2000000], packet_size_histogram=dict(zip(sizes, [1, 1, 0, 1, 1, 1, 0])), iat_histogram=dict(zip(iats, [0, 1, 1, 1, 0, 1])), pkt_size_min=60, pkt_size_max=1400, idle_gap_count=1, burst_count=1, direction_changes=1, rtt_estimate_us=900),
        flow(1, *a, 102, "CLOSE", close_reason="fin", bytes_sent=1024, bytes_recv=4096, packets_sent=9, packets_recv=14),
        flow(2, *b, 200, "CONNECT"),
        flow(2, *b, 201, "CLOSE", close_reason="rst", rst_count=1),
        flow(3, *c, 300, "CONNECT"),
        flow(3, *c, 300.1, "TLS_HANDSHAKE", handshake_seen=True, tls_version="1.3", alpn="h2", ja4="t13d1516h2_8daaf6152771_e5627efa2ab1", sni_hash="a379a6f6eeafb9a5", tls_parse_status="parsed"),
        flow(3, *c, 300.2, "TLS_HANDSHAKE", **server),
        flow(3, *c, 301, "STATS", packet_sizes=[128, 512, 1500], iat_us=[5000, 8000], packet_size_histogram=dict(zip(sizes, [0, 0, 1, 0, 1, 1, 0])), iat_histogram=dict(zip(iats, [0, 0, 2, 0, 0, 0])), pkt_size_min=128, pkt_size_max=1500, burst_count=2, retrans_count=1, **last),
        flow(3, *c, 302, "CLOSE", close_reason="fin", **last),
        flow(4, *d, 400, "CONNECT"),
        flow(4, *d, 401, "CLOSE"),
        flow(5, *e, 500, "CONNECT"),
        flow(5, *e, 901, "STATS", bytes_sent=10240, bytes_recv=20480, packets_sent=100, packets_recv=150, packet_sizes=list(range(100, 701, 100)), iat_us=[1000, 1000, 1000, 3000000]),
        flow(5, *e, 902, "CLOSE", close_reason="fin", bytes_sent=10240, bytes_recv=20480, packets_sent=100, packets_recv=150),
        flow(6, *f, 1000, "CONNECT"),
        flow(6, *f, 1001, "CLOSE"),
    ]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("events") / "events.jsonl"
    path.write_text("\n\n".join(json.dumps(x) for x in replay()))  # blank lines are skipped, the last needs no line break
    return src.normalise(src.read_jsonl(spark, str(path)))


def test_replay(spark, events):
    rows = {r.flow_id[:8]: r for r in sessions.sessions(events).collect()}
    assert set(rows) == {"190f1295", "0bee4ac3", "5fd01365", "6b71fa34", "2a4183e4", "b4a831c1"}
    one, three, five = rows["190f1295"], rows["5fd01365"], rows["2a4183e4"]
    assert one.flow_id == "190f12957f55cf7e6e05a77a64d1779b3656314d"
    assert (one.close_reason, one.tcp_state, one.duration_ms, one.event_count) == ("fin", "established", 2000, 3)
    assert (one.bytes_out, one.bytes_in, one.packets_out, one.packets_in) == (1024, 4096, 9, 14)
    assert [one.byte_ratio_out_in, one.packet_ratio_out_in, one.byte_rate, one.packet_rate] == pytest.approx([0.25, 0.642857142857, 2560, 11.5])
    assert [one.pkt_size_mean, one.pkt_size_p50, one.pkt_size_p95, one.iat_p50, one.iat_p95] == pytest.approx([508, 383.5, 1381, 10000, 1000001])
    assert [one.pkt_size_histogram[b] for b in S.PACKET_BUCKETS] == [2, 2, 0, 2, 2, 2, 0] and one.iat_std is None
    assert (one.idle_gap_count, one.burst_count, one.rtt_estimate_us, one.syn_count, one.fin_count) == (2, 3, 900, 1, 1)
    assert rows["0bee4ac3"].rst_count == 1 and rows["0bee4ac3"].close_reason == "rst" and rows["0bee4ac3"].byte_ratio_out_in is None
    assert [three.pkt_size_mean, three.pkt_size_p50, three.pkt_size_p95, three.iat_p50, three.iat_p95] == pytest.approx([740.333333333, 767.5, 1428.6, 5500, 9550])
    assert (three.handshake_seen, three.tls_version, three.server_hello_seen, three.ja4s, three.retrans_count) == (True, "1.3", True, "t1201h2_c02f_0b08e3dcc50f", 1)
    assert [five.pkt_size_p50, five.pkt_size_p95, five.iat_p95, five.iat_std] == pytest.approx([400, 670, 2550150, 1298605.09297])
    assert five.is_long_lived and not one.is_long_lived
    assert rows["6b71fa34"].close_reason == "unknown"


def test_window_of_the_replay(events):
    (w,) = sessions.window_summaries(events).collect()
    assert (w.flow_id[:8], w.window_id, w.duration_ms, w.event_count, w.close_reason, w.fin_count) == ("2a4183e4", 1, 401000, 2, "", 0)
    assert [w.byte_rate, w.packet_rate] == pytest.approx([76.608478803, 0.623441396509])


def test_records_of_the_replay(spark, events, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in (("pods", S.PODS), ("workloads", S.WORKLOADS), ("cgroups", S.CGROUPS), ("services", S.SERVICES), ("endpoint_slices", S.ENDPOINT_SLICES))}
    both = sessions.sessions(events).unionByName(sessions.window_summaries(events))
    made = ledger.ledger_record(identity.resolve(both, empty))
    assert len(made.columns) == 144
    rows = {(r.flow_id[:8], r.window_id): r for r in made.collect()}
    three = rows["5fd01365", 0]
    assert (three.direction, three.dst_mapping_confidence, three.mapping_method, three.pod_restart_window, three.protocol_guess) == ("egress", "low", "external", True, "tls")
    assert three.reason_codes == ["EXTERNAL_DESTINATION", "UNKNOWN_IDENTITY"] and three.start_time == "1970-01-01T00:05:00Z"
    assert rows["0bee4ac3", 0].reason_codes == ["UNKNOWN_IDENTITY", "VISIBILITY_DEGRADED"] and rows["0bee4ac3", 0].visibility_degraded_reason == "traffic_accounting_unavailable"
    assert rows["2a4183e4", 1].close_reason == "unknown" and rows["2a4183e4", 0].reason_codes == ["LONG_LIVED", "UNKNOWN_IDENTITY"]
    ledger.write_ledger(made, str(tmp_path / "out"), rows_per_file=2)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 7 and all("fast_score" in x and x["fast_score"] is None for x in lines)


def test_gap_timeout_splits(events):
    assert sessions.sessions(events, timeout_ns=60 * G).count() == 7


def frame(spark, rows):
    return src.normalise(spark.createDataFrame([{**r, "seq": i} for i, r in enumerate(rows)], src.T.StructType([*S.FLOW_EVENT.fields, src.T.StructField("seq", src.T.LongType())])))


K = ("10.0.0.1", 1000, "10.0.0.2", 443)


def test_tls_before_connect_is_lost(spark):
    hello = {"ja4": "x", "handshake_seen": True}
    e = frame(spark, [flow(1, *K, 1, "TLS_HANDSHAKE", **hello), flow(1, *K, 2, "CONNECT"), flow(1, *K, 3, "TLS_HANDSHAKE", ja4s="y", server_hello_seen=True), flow(1, *K, 4, "CLOSE")])
    (s,) = sessions.sessions(e).collect()
    assert (s.ja4, s.ja4s, s.event_count) == ("", "y", 2)
    assert sessions.unmatched_tls(e).count() == 1


def test_failed_hello_leaves_no_status(spark):
    e = frame(spark, [flow(1, *K, 1, "CONNECT"), flow(1, *K, 2, "tls_handshake", tls_payload_hex="1603010200010001fc", direction=1), flow(1, *K, 3, "CLOSE")])
    (s,) = sessions.sessions(e).collect()
    assert s.tls_parse_status == "" and not s.handshake_seen
    assert [r.tls_parse_status for r in e.where("event_type = 'TLS_HANDSHAKE'").collect()] == ["fragmented"]


def test_windows_then_close(spark):
    e = frame(spark, [flow(1, *K, 0, "CONNECT"), flow(1, *K, 1.5, "STATS", bytes_sent=5), flow(1, *K, 3, "CLOSE")])
    (w,) = sessions.window_summaries(e, window_ns=G, long_lived_ns=2 * G).collect()
    (s,) = sessions.sessions(e, long_lived_ns=2 * G).collect()
    assert w.window_id == 1 and not w.is_long_lived and s.window_id == 0 and s.is_long_lived


def test_counters_take_the_maximum_and_sessions_reopen(spark):
    e = frame(spark, [flow(1, *K, 1, "CONNECT"), flow(1, *K, 2, "STATS", bytes_sent=300), flow(1, *K, 3, "STATS", bytes_sent=100), flow(1, *K, 4, "CLOSE"), flow(1, *K, 5, "STATS", bytes_sent=7), flow(1, *K, 6, "DROP")])
    rows = sessions.sessions(e, flush_ns=9 * G).orderBy("session_no").collect()
    assert [(r.bytes_out, r.close_reason, r.end_ns) for r in rows] == [(300, "unknown", 4 * G), (7, "timeout", 9 * G)]


def test_nat_alias(spark):
    back = ("10.0.0.1", 1000, "10.1.1.10", 8443)
    e = frame(spark, [flow(1, *K, 1, "CONNECT"), flow(1, *back, 2, "TLS_HANDSHAKE", ja4s="y", server_hello_seen=True, direction=2), flow(1, *back, 2.5, "TLS_HANDSHAKE", ja4="x", handshake_seen=True), flow(1, *K, 3, "CLOSE")])
    a = spark.createDataFrame([("10.1.1.10", 8443, "udp", "10.0.0.3", 443, 0), ("10.1.1.10", 8443, "TCP", "10.0.0.2", 443, 1)], "backend_ip string, backend_port int, protocol string, cluster_ip string, service_port int, alias_seq int")
    moved = sessions.with_nat_aliases(e, a)
    assert [r.alias for r in moved.where("alias IS NOT NULL").collect()] == ["hit"]
    other = sessions.with_nat_aliases(e, a.where("protocol = 'udp'"))  # aliases of another protocol are none
    assert [r.alias for r in other.where("alias IS NOT NULL").collect()] == ["miss"]
    (s,) = sessions.summarise(moved, [*S.KEY, "session_no"]).collect()
    assert s.ja4s == "y" and s.ja4 == ""


def test_empty_events(spark):
    e = frame(spark, [])
    assert sessions.sessions(e).count() == 0 and sessions.window_summaries(e).count() == 0


def test_strict_read_fails_on_a_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event_type": "CONNECT"}\n{"event_type": \n')
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=True).collect()
    rows = src.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()
    assert [r._corrupt_record is None for r in rows] == [True, False]
