"""Drifting gates, prefix ranks and window summaries against plain loops, and long sessions in linear time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import packets, sessions
from sessionlens.operators.gates import drifting_gates
from sessionlens.operators.prefix_ranks import prefix_ranks
from sessionlens.sources.flow_events import normalise

G = 1_000_000_000


def gates(rows, interval):
    """rows of one group in order: (at, opens, may pass)."""
    last, out = None, []
    for place, (at, opens, may) in enumerate(rows, 1):
        if last is None:
            last = at if opens else None
        elif may and at - last >= interval:
            out.append(place)
            last = at
    return out


@pytest.mark.parametrize("interval", [0, 7, 1000])
def test_drifting_gates_equal_a_loop(spark, interval):
    rnd = random.Random(interval)
    groups = {f"g{k}": [(t, rnd.random() < 0.8, rnd.random() < 0.7) for t in sorted(rnd.randrange(300) for _ in range(rnd.choice([1, 3, 40, 400])))] for k in range(60)}
    rows = [(g, p, *r) for g, own in groups.items() for p, r in enumerate(own, 1)]
    rnd.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # groups cross batches
    try:
        df = spark.createDataFrame(rows, "g string, place long, at long, o boolean, may boolean")
        got = {}
        for r in drifting_gates(df, ["g"], "place", "at", F.col("o"), F.col("may"), interval).collect():
            got.setdefault(r.g, []).append((r.n, r.place))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {g: [p for _, p in sorted(x)] for g, x in got.items()} == {g: x for g, own in groups.items() if (x := gates(own, interval))}
    assert all(sorted(n for n, _ in x) == list(range(1, len(x) + 1)) for x in got.values())


@pytest.mark.parametrize("low,high", [(0, 50), (-9, 10**11), (5, 5)])
def test_prefix_ranks_equal_sorting(spark, low, high):
    rnd = random.Random(high)
    samples = [(f"g{rnd.randrange(5)}", rnd.randrange(1, 9), rnd.randint(low, high), rnd.randint(1, 3)) for _ in range(300)]
    queries, want = [], {}
    for g in {s[0] for s in samples}:
        for step in range(1, 10):
            upto = sorted(v for h, s, v, n in samples if h == g and s <= step for _ in range(n))
            for rank in {0, len(upto) // 2, len(upto) - 1} if upto else ():
                queries.append((g, step, rank))
                want[g, step, rank] = upto[rank]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        df = prefix_ranks(spark.createDataFrame(samples, "g string, step long, value long, n long"), spark.createDataFrame(queries, "g string, step long, rank long"))
        assert {(r.g, r.step, r.rank): r.value for r in df.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def events(spark, rows):
    """rows: src_port, seconds, type, sizes, gaps."""
    df = spark.createDataFrame([(k, p, int(s * G), t, sizes, gaps) for k, (p, s, t, sizes, gaps) in enumerate(rows)], "seq long, src_port int, timestamp_ns long, event_type string, packet_sizes array<long>, iat_us array<long>")
    return normalise(df.withColumns({"src_ip": F.lit("10.0.0.1"), "dst_ip": F.lit("10.0.0.2"), "dst_port": F.lit(443)}), decode_tls=False)


def test_window_features_equal_the_samples_so_far(spark):
    rnd = random.Random(8)
    rows = []
    for port in range(12):
        at = 0.0
        for _ in range(80):
            at += rnd.choice([0, 1, 5, 29, 30, 31, 100])
            rows.append((port, at, rnd.choice(["STATS"] * 8 + ["CONNECT", "CLOSE"]), [rnd.randrange(2000) for _ in range(rnd.choice([0, 0, 1, 3]))], [rnd.randrange(3_000_000) for _ in range(rnd.choice([0, 1, 2]))]))
    got = {(r.src_port, r.session_no, r.window_id): r for r in sessions.window_summaries(events(spark, rows)).collect()}
    want = {}
    for port in range(12):
        no, held, gate, n = 0, [], None, 0
        for r in (r for r in rows if r[0] == port):
            held.append(r)
            if gate is None:
                gate = r[1]
            if r[2] == "CLOSE":
                no, held, gate, n = no + 1, [], None, 0
            elif len(held) > 1 and r[1] - gate >= 30:
                gate, n = r[1], n + 1
                want[port, no, n] = (len(held), r[1], [v for x in held for v in x[3]], [v for x in held for v in x[4]])
    assert got.keys() == want.keys() and len(want) > 200
    close = lambda a, b: a is None and b is None or a == pytest.approx(b)
    for key, (count, end, sizes, gaps) in want.items():
        r = got[key]
        assert (r.event_count, r.end_ns) == (count, int(end * G))
        assert (r.pkt_size_min, r.pkt_size_max) == ((min(sizes), max(sizes)) if sizes else (None, None))
        assert close(r.pkt_size_mean, np.mean(sizes) if sizes else None) and close(r.iat_std, np.std(gaps) if gaps else None)
        for p, a, b in ((0.5, r.pkt_size_p50, r.iat_p50), (0.95, r.pkt_size_p95, r.iat_p95)):
            assert close(a, np.quantile(sizes, p) if sizes else None) and close(b, np.quantile(gaps, p) if gaps else None)
        assert sum(r.pkt_size_histogram.values()) == len(sizes) and r.idle_gap_count == sum(v > 1_000_000 for v in gaps)


def long_session(spark, windows):
    """One session, an event every 10 seconds, with a size and a gap each."""
    df = spark.range(3 * windows + 1).select(F.col("id").alias("seq"), (F.col("id") * 10 * G).alias("timestamp_ns"), F.lit("STATS").alias("event_type"), F.array(F.col("id") * 7919 % 1500).alias("packet_sizes"), F.array(F.col("id") * 104729 % 9_999_991).alias("iat_us"))
    return normalise(df.withColumns({"src_ip": F.lit("10.0.0.1"), "src_port": F.lit(1), "dst_ip": F.lit("10.0.0.2"), "dst_port": F.lit(443)}), decode_tls=False)


def test_ten_thousand_windows_of_one_session(spark):
    """Time goes with the events: ten times the windows take far less than ten times as long."""
    seconds = {}
    for n in (1_000, 10_000):
        start = time.perf_counter()
        out = sessions.window_summaries(long_session(spark, n)).where(f"window_id IN (1, {n // 2}, {n})").collect()
        seconds[n] = time.perf_counter() - start
        for r in out:
            sizes, gaps = ([k * m % q for k in range(3 * r.window_id + 1)] for m, q in ((7919, 1500), (104729, 9_999_991)))
            assert r.pkt_size_p50 == np.quantile(sizes, 0.5) and r.iat_p95 == pytest.approx(np.quantile(gaps, 0.95))
        assert len(out) == 3
    assert seconds[10_000] < 6 * seconds[1_000] + 20


def test_rate_limited_packets(spark):
    rows = [("f", 0, 1, 10, True), ("f", 4, 2, 10, True), ("f", 5, 3, 7, False), ("f", 9, 4, 0, True), ("f", 10, 5, 0, True), ("f", 11, 6, 1, True), ("f", 11, 7, 1, True), ("g", 3, 8, 5, True)]
    df = spark.createDataFrame([(k, s * G, q, n, o) for k, s, q, n, o in rows], "flow string, ts_ns long, seq int, length long, o boolean")
    got = packets.rate_limited_stats(df, ["flow"], F.col("o")).orderBy("timestamp_ns").collect()
    assert [(r.timestamp_ns // G, r.bytes_sent, r.bytes_recv, r.packets_sent, r.packets_recv, r.event_type) for r in got] == [(5, 20, 7, 2, 1, "STATS"), (11, 21, 7, 3, 1, "STATS")]
