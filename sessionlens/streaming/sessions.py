"""Sessions of a stream: typed state per 5-tuple, event-time timers, the same columns as batch.

State is a row of typed values (counters, first and last values, bucket counts) and two maps: how many samples lie in each range of
values, and the values of a range with their counts. So a percentile is exact at any length of a session and reads the counts of the
ranges and one range. What a micro-batch changes is written once, at its end. Rows of a key in one micro-batch are put in order of
(timestamp_ns, seq) before they are folded. The operator gives sums; rates, ratios and estimates follow in the expressions that
batch has.

A session ends by CLOSE, by the watermark passing its last update by the timeout, or by a drain: a row of drain_rows() moves the
watermark beyond every timer, and all open sessions end at its time. Needs the RocksDB state store, which is set where no other is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import TLS_CLIENT, TLS_SERVER, finished
from ..schema import DEFAULTS, FLOW_EVENT, IAT_BOUNDS, IAT_BUCKETS, KEY, PACKET_BOUNDS, PACKET_BUCKETS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Drain rows lie so many seconds after the time at which they end sessions (some thousand years).
DRAIN_S = 100_000_000_000
MAXED = {"bytes_out": "bytes_sent", "bytes_in": "bytes_recv", "packets_out": "packets_sent", "packets_in": "packets_recv"}
SUMMED = ["direction_changes", "syn_count", "fin_count", "rst_count", "retrans_count", "idle_gap_count", "burst_count"]
FLAGS = ["traffic_accounting_available", "packet_timing_available", "tcp_metrics_available"]
FIRST = {"cgroup_id": T.LongType(), "netns_ino": T.LongType(), "node_name": T.StringType()}

_L, _S, _B, _D = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()
_LIST = T.ArrayType(_L)


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: What the operator gives for a record; finished() makes the columns of a session of it.
OUTPUT = _struct(
    {f.name: f.dataType for f in FLOW_EVENT.fields if f.name in KEY}
    | {"record_type": _S, "window_id": _L, "flush_ns": _L, "start_ns": _L, "last_ns": _L, "event_count": _L, "closed": T.IntegerType(), "raw_reason": _S, "tcp_state": _S, "rtt_estimate_us": _L}
    | FIRST | dict.fromkeys((*MAXED, *SUMMED), _L) | dict.fromkeys((*FLAGS, "handshake_seen", "server_hello_seen"), _B) | dict.fromkeys((*TLS_CLIENT, *TLS_SERVER), _S)
    | {"pkt_size_min": _L, "pkt_size_max": _L, "__reported_sizes": _LIST, "__reported_iats": _LIST, "__raw_sizes": _LIST, "__raw_iats": _LIST, "__other_sizes": T.MapType(_S, _L)}
    | dict.fromkeys(("__mean", "__p50", "__p95", "__i50", "__i95", "__istd"), _D) | {"__idle": _L, "__burst": _L}
)
#: An open session: the record's values so far and what only the fold needs. Samples: number, sum, sum of squares.
HEAD = _struct(
    {f.name: f.dataType for f in OUTPUT.fields if f.name not in {*KEY, "record_type", "window_id", "flush_ns", "__mean", "__p50", "__p95", "__i50", "__i95", "__istd"}}
    | {"gate_ns": _L, "windows": _L, "touched_ns": _L, "timer_ms": _L, "size_n": _L, "size_sum": _L, "gap_n": _L, "gap_sum": _L, "gap_squares": T.DecimalType(38, 0)}
)
RANGE = _struct({"kind": _S, "range": T.IntegerType()})
EVENT = [*KEY, "timestamp_ns", "seq", "event_type", *MAXED.values(), "packet_sizes", "iat_us", "sizes", "iats", "packet_size_histogram", "pkt_size_min", "pkt_size_max", *SUMMED, "rtt_estimate_us", "tcp_state", "close_reason", *FIRST, *FLAGS, "handshake_seen", "server_hello_seen", *TLS_CLIENT, *TLS_SERVER]


def value_range(v: int) -> int:
    """Ranges in order of their values: 32 for each power of two."""
    if v < 0:
        return -1 - value_range(-v)
    bits = v.bit_length()
    return v if bits <= 5 else 32 * (bits - 5) + (v >> (bits - 6))


def _bucket(value: int, bounds: list[tuple[int, int]]) -> int:
    return next((k for k, (_, high) in enumerate(bounds[:-1]) if value <= high), len(bounds) - 1)


class Samples:
    """The two maps of a session, read as needed; flush() writes what changed."""

    def __init__(self, counts, values):
        self.counts_state, self.values_state = counts, values
        self.counts: dict | None = None
        self.values: dict = {}
        self.changed: set = set()

    def load(self) -> dict:
        if self.counts is None:
            self.counts = {tuple(k): v[0] for k, v in self.counts_state.iterator()}
        return self.counts

    def of(self, key: tuple) -> dict:
        if key not in self.values:
            held = self.values_state.getValue(key) if key in self.load() else None
            self.values[key] = dict(zip(held[0], held[1], strict=True)) if held else {}
        return self.values[key]

    def add(self, kind: str, v: int) -> None:
        key = (kind, value_range(v))
        own = self.of(key)
        own[v] = own.get(v, 0) + 1
        counts = self.load()
        counts[key] = counts.get(key, 0) + 1
        self.changed.add(key)

    def ranked(self, kind: str, rank: int) -> int:
        for key in sorted(k for k in self.load() if k[0] == kind):
            if rank < self.counts[key]:
                for v, n in sorted(self.of(key).items()):
                    if rank < n:
                        return v
                    rank -= n
            rank -= self.counts[key]
        raise IndexError(rank)

    def percentile(self, kind: str, n: int, p: float) -> float | None:
        if not n:
            return None
        at = p * (n - 1)
        low = math.floor(at)
        a, b = self.ranked(kind, low), self.ranked(kind, min(low + 1, n - 1))
        return a + (b - a) * (at - low)

    def flush(self) -> None:
        for key in self.changed:
            own = self.values[key]
            self.counts_state.updateValue(key, (self.counts[key],))
            self.values_state.updateValue(key, (list(own), list(own.values())))
        self.changed = set()

    def clear(self) -> None:
        self.counts_state.clear()
        self.values_state.clear()
        self.counts, self.values, self.changed = {}, {}, set()


def opened(ns: int, row: Row) -> dict:
    s = dict.fromkeys(HEAD.names)
    s |= dict.fromkeys((*MAXED, *SUMMED, "event_count", "windows", "size_n", "size_sum", "gap_n", "gap_sum", "__idle", "__burst", "closed"), 0) | dict.fromkeys((*FLAGS, "handshake_seen", "server_hello_seen"), False)
    s |= {"start_ns": ns, "last_ns": ns, "gate_ns": ns, "touched_ns": ns, "gap_squares": 0, "__reported_sizes": [0] * 7, "__raw_sizes": [0] * 7, "__reported_iats": [0] * 6, "__raw_iats": [0] * 6, "__other_sizes": {}}
    return s | {c: row[c] for c in FIRST}


def add_event(s: dict, row: Row, samples: Samples) -> None:
    ns, kind = row["timestamp_ns"], row["event_type"]
    s["event_count"] += 1
    s["last_ns"], s["touched_ns"] = ns, max(s["touched_ns"], ns)
    s["tcp_state"] = row["tcp_state"] or s["tcp_state"]
    s["rtt_estimate_us"] = row["rtt_estimate_us"] if row["rtt_estimate_us"] > 0 else s["rtt_estimate_us"]
    for a, b in MAXED.items():
        s[a] = max(s[a], row[b])
    for c in SUMMED:
        s[c] += row[c]
    s["syn_count"] += kind in ("CONNECT", "ACCEPT")
    s["fin_count"] += kind == "CLOSE"
    if kind == "CLOSE":
        s["closed"], s["raw_reason"] = 1, row["close_reason"]
    for c in FLAGS:
        s[c] = s[c] or row[c]
    for c, reported in (("__reported_sizes", row["sizes"]), ("__reported_iats", row["iats"])):
        s[c] = [a + b for a, b in zip(s[c], reported, strict=True)]
    for k, n in dict(row["packet_size_histogram"] or {}).items():  # pairs, as Arrow has maps
        if k not in PACKET_BUCKETS:
            s["__other_sizes"][k] = s["__other_sizes"].get(k, 0) + n
    low = [v for v in (s["pkt_size_min"], row["pkt_size_min"], *row["packet_sizes"]) if v is not None]
    high = [v for v in (s["pkt_size_max"], row["pkt_size_max"], *row["packet_sizes"]) if v is not None]
    s["pkt_size_min"], s["pkt_size_max"] = min(low, default=None), max(high, default=None)
    for v in row["packet_sizes"]:
        samples.add("size", v)
        s["__raw_sizes"][_bucket(v, PACKET_BOUNDS)] += 1
        s["size_n"] += 1
        s["size_sum"] += v
    for v in row["iat_us"]:
        samples.add("gap", v)
        s["__raw_iats"][0 if v < 100 else max(1, _bucket(v, IAT_BOUNDS))] += 1
        s["gap_n"] += 1
        s["gap_sum"] += v
        s["gap_squares"] = int(s["gap_squares"]) + v * v
        s["__idle"] += v > 1_000_000
        s["__burst"] += 0 < v < 10_000


def add_hello(s: dict, row: Row) -> None:
    s["touched_ns"] = max(s["touched_ns"], row["timestamp_ns"])
    if row["ja4"] or row["handshake_seen"]:
        s["handshake_seen"] = s["handshake_seen"] or row["handshake_seen"]
        s |= {c: row[c] for c in TLS_CLIENT}
    if row["ja4s"] or row["server_hello_seen"]:
        s["server_hello_seen"] = s["server_hello_seen"] or row["server_hello_seen"]
        s |= {c: row[c] for c in TLS_SERVER}


class SessionProcessor(StatefulProcessor):
    def __init__(self, timeout_ns: int, window_ns: int, delay_ms: int):
        self.timeout_ns, self.window_ns, self.delay_ms = timeout_ns, window_ns, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.counts = handle.getMapState("sample_counts", RANGE, _struct({"n": _L}))
        self.values = handle.getMapState("sample_values", RANGE, _struct({"values": _LIST, "counts": _LIST}))

    def record(self, key: tuple, s: dict, samples: Samples, kind: str, window: int, flush_ns: int | None) -> Row:
        n, total = s["gap_n"], s["gap_sum"]
        made = dict(zip(KEY, key, strict=True)) | {"record_type": kind, "window_id": window, "flush_ns": flush_ns, "__mean": s["size_sum"] / s["size_n"] if s["size_n"] else None}
        made |= {"__istd": math.sqrt(n * int(s["gap_squares"]) - total * total) / n if n else None}
        made |= {name: samples.percentile(of, s[f"{of}_n"], p) for name, of, p in (("__p50", "size", 0.5), ("__p95", "size", 0.95), ("__i50", "gap", 0.5), ("__i95", "gap", 0.95))}
        held = {c: list(v) if isinstance(v, list) else v for c, v in s.items()}  # the fold goes on with its lists
        held["__other_sizes"] = dict(s["__other_sizes"] or {}) if kind == "session_summary" else {}
        return Row(**{c: made[c] if c in made else held[c] for c in OUTPUT.names})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.head.get() if self.head.exists() else None
        s = dict(zip(HEAD.names, held, strict=True)) if held is not None else None
        if s is not None:
            s["__other_sizes"] = dict(s["__other_sizes"] or {})
        timer, samples, out = s["timer_ms"] if s else None, Samples(self.counts, self.values), []
        for row in sorted(rows, key=lambda r: (r["timestamp_ns"], r["seq"])):
            kind = row["event_type"]
            if kind in ("DRAIN", "TLS_HANDSHAKE"):
                if s is not None and kind == "TLS_HANDSHAKE":
                    add_hello(s, row)
                continue
            if s is None:
                s = opened(row["timestamp_ns"], row)
            add_event(s, row, samples)
            if kind == "CLOSE":
                out.append(self.record(key, s, samples, "session_summary", 0, None))
                s = None
                samples.clear()
            elif kind in ("CONNECT", "ACCEPT", "STATS") and s["event_count"] > 1 and row["timestamp_ns"] - s["gate_ns"] >= self.window_ns:
                s["windows"] += 1
                s["gate_ns"] = row["timestamp_ns"]
                out.append(self.record(key, s, samples, "window_summary", s["windows"], None))
        due = max((s["touched_ns"] + self.timeout_ns) // 1_000_000, timerValues.getCurrentWatermarkInMs() + 1) if s else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if s is None:
            self.head.clear()
        else:
            if timer != due:
                self.handle.registerTimer(due)
            s["timer_ms"], s["gap_squares"] = due, Decimal(int(s["gap_squares"]))
            self.head.update(tuple(s[c] for c in HEAD.names))
            samples.flush()
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.head.exists():
            return
        s = dict(zip(HEAD.names, self.head.get(), strict=True))
        drained_ms = timerValues.getCurrentWatermarkInMs() + self.delay_ms - DRAIN_S * 1000
        natural = expiredTimerInfo.getExpiryTimeInMs() < drained_ms  # it had timed out by then anyway
        samples = Samples(self.counts, self.values)
        yield self.record(key, s, samples, "session_summary", 0, drained_ms * 1_000_000 if drained_ms > 0 and not natural else None)
        self.head.clear()
        samples.clear()

    def close(self) -> None:
        pass


def drain_rows(drains: DataFrame) -> DataFrame:
    """Rows to union with a stream's events: each ends all open sessions at flush_ns (whole milliseconds). drains: flush_ns.

    Nothing that comes later is in time any more.
    """
    zero = {f.name: F.lit("" if isinstance(f.dataType, T.StringType) else None).cast(f.dataType) for f in FLOW_EVENT.fields}
    return drains.select(*[v.alias(k) for k, v in (zero | {"timestamp_ns": F.col("flush_ns").cast("long"), "event_type": F.lit("DRAIN")}).items()])


def session_records(events: DataFrame, session_timeout_ns: int, window_ns: int, watermark: str, unique: list[str] | None = None) -> DataFrame:
    """The sums of each record as it ends (OUTPUT). unique: columns that tell events apart; repeated ones within the watermark go."""
    spark: SparkSession = events.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(store, ""):
        spark.conf.set(store, STORE)
    delay_ms = spark.range(1).select(F.expr(f"timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + interval {watermark})")).first()[0]
    count = lambda m, labels: F.array(*[F.coalesce(F.try_element_at(m, F.lit(b)), F.lit(0)).cast("long") for b in labels])
    rows = events.where("event_type <> 'DROP'").withColumns({"sizes": count("packet_size_histogram", PACKET_BUCKETS), "iats": count("iat_histogram", IAT_BUCKETS)})
    shift = F.when(F.col("event_type") == "DRAIN", DRAIN_S * 1_000_000).otherwise(0)
    rows = rows.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("long") + shift)).withWatermark("event_time", watermark)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(unique)
    if "seq" not in events.columns:  # any fixed order of equal times
        rows = rows.withColumn("seq", F.xxhash64("event_type", *[c for c in MAXED.values()], "packet_sizes", "iat_us", "ja4", "ja4s", "close_reason"))
    return rows.select(*EVENT, "event_time").groupBy(*KEY).transformWithState(SessionProcessor(session_timeout_ns, window_ns, delay_ms), OUTPUT, "append", "EventTime")


def streaming_sessions(events: DataFrame, session_timeout_ns: int = DEFAULTS["session_timeout_ns"], window_ns: int = DEFAULTS["window_ns"], long_lived_ns: int = DEFAULTS["long_lived_ns"], watermark: str = "1 minute", unique: list[str] | None = None) -> DataFrame:
    """events: a normalised stream, with a seq where equal times have an order. Session and window summaries as they come; append mode.

    The columns are those of batch sessions, but for session_no: a stream keeps no count of the sessions that a key has had.
    """
    out = session_records(events, session_timeout_ns, window_ns, watermark, unique)
    return finished(out, long_lived_ns, F.col("flush_ns"), F.col("record_type") == "session_summary").drop("flush_ns")
