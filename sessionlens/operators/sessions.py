"""Batch sessions: numbering, window gates, aggregation and features.

A session holds the events of one 5-tuple (and node, if given) from the first one up to a CLOSE; the next event opens another.
Order is (timestamp_ns, seq). TLS rows never open a session; those without an open one are unmatched. One shuffle by key serves
numbering, TLS matching and aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net, stats, text
from ..schema import DEFAULTS, IAT_BOUNDS, IAT_BUCKETS, KEY, PACKET_BOUNDS, PACKET_BUCKETS
from ..storage import stored
from .gates import drifting_gates
from .prefix_ranks import prefix_ranks

TLS_CLIENT = ["tls_version", "sni_hash", "alpn", "ja4", "tls_parse_status"]
TLS_SERVER = ["tls_version_negotiated", "alpn_negotiated", "ja4s", "tls_server_parse_status"]


def number_sessions(events: DataFrame, keys: list[str] | None = None, timeout_ns: int | None = None) -> DataFrame:
    """Adds session_no (from 0) and matched (false for TLS rows without an open session). DROP rows go.

    With timeout_ns a gap beyond it also ends a session (event time); without, only CLOSE does.
    """
    keys = keys or KEY
    rows = events.where("event_type <> 'DROP'")
    order = Window.partitionBy(*keys).orderBy("timestamp_ns", "seq")
    flow = F.col("event_type") != "TLS_HANDSHAKE"
    before = F.lag(F.when(flow, F.col("event_type"))).over(order)
    starts = F.coalesce((before == "CLOSE").cast("int"), F.lit(0))
    if timeout_ns is not None:
        gap = F.col("timestamp_ns") - F.lag("timestamp_ns").over(order) > timeout_ns
        starts = F.greatest(starts, F.coalesce(gap.cast("int"), F.lit(0)))
    numbered = rows.withColumn("__start", starts).withColumn("session_no", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "session_no").orderBy("timestamp_ns", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("matched", flow | (F.max(flow.cast("int")).over(inside) == 1)).drop("__start")


def window_emissions(numbered: DataFrame, window_ns: int = DEFAULTS["window_ns"], keys: list[str] | None = None) -> DataFrame:
    """keys, session_no, place, n: the events that emit a window, by their place in the session.

    A window is emitted by the first CONNECT, ACCEPT or STATS at least window_ns after the last emission (at first: the start);
    the gate then moves to that event, so windows follow no grid.
    """
    group = [*(keys or KEY), "session_no"]
    gate = F.col("matched") & F.col("event_type").isin("CONNECT", "ACCEPT", "STATS")
    return drifting_gates(placed(numbered, group), group, "__place", "timestamp_ns", F.col("matched"), gate, window_ns)


def placed(numbered: DataFrame, group: list[str]) -> DataFrame:
    return numbered.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy("timestamp_ns", "seq")).cast("long"))


def window_gates(numbered: DataFrame, window_ns: int = DEFAULTS["window_ns"], keys: list[str] | None = None) -> DataFrame:
    """Adds emitted, the window number that an event emits (null: none), windows_before, how many the session emitted earlier, and windows, how many it emits at all."""
    group = [*(keys or KEY), "session_no"]
    out = placed(numbered, group).join(window_emissions(numbered, window_ns, keys).withColumnRenamed("n", "emitted"), [*group, "__place"], "left")
    order = Window.partitionBy(*group).orderBy("timestamp_ns", "seq")
    before = F.count("emitted").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumns({"windows_before": before.cast("int"), "windows": F.count("emitted").over(Window.partitionBy(*group)).cast("int")}).drop("__place")


def _histogram(column: str, label: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(column), F.lit(label)), F.lit(0))


def _other_labels(histogram: Column, labels: list[str]) -> Column:
    """The labels of a histogram that are none of the buckets'; null where there are none."""
    other = F.map_filter(histogram, lambda k, v: ~k.isin(labels))
    return F.when(F.size(other) > 0, other)


def _added(maps: Column) -> Column:
    """Sums of a list of maps by label."""
    zero = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    plus = lambda k, a, b: F.coalesce(a, F.lit(0).cast("long")) + F.coalesce(b, F.lit(0).cast("long"))
    return F.aggregate(maps, zero, lambda acc, m: F.map_zip_with(acc, m, plus))


def summarise(rows: DataFrame, by: list[str], long_lived_ns: int = DEFAULTS["long_lived_ns"], flush_ns: int | None = None, closing: bool = True, keys: list[str] | None = None, counter_mode: str = "event") -> DataFrame:
    """One row per group of by: lifecycle, counters, features, last TLS values.

    rows: number_sessions() rows that matched. closing: the group ends by CLOSE, else (still open) at flush_ns with reason
    timeout; without closing (window summaries) it ends at its last flow event, without a reason.
    Raw samples are spread into narrow rows, so percentiles and counts are aggregated in part before the groups meet.
    counter_mode "event" sums the counters of all events; "cumulative" takes their maximum. Labels of reported size histograms that
    are no buckets are kept in the session's histogram, and count in no estimate.
    """
    keys = keys or KEY
    sample = "struct<kind:int,v:bigint>"
    spread = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("v"))).cast(f"array<{sample}>"),
        F.transform("packet_sizes", lambda v: F.struct(F.lit(1).alias("kind"), v.alias("v"))),
        F.transform("iat_us", lambda v: F.struct(F.lit(2).alias("kind"), v.alias("v"))),
    )
    x = rows.where("matched").withColumn("__s", F.explode(spread))
    head, flow = F.col("__s.kind") == 0, F.col("event_type") != "TLS_HANDSHAKE"
    own = head & flow
    order = F.struct("timestamp_ns", "seq")
    size, iat = F.when(F.col("__s.kind") == 1, F.col("__s.v")), F.when(F.col("__s.kind") == 2, F.col("__s.v"))
    kind = F.col("event_type")
    size_bucket, iat_bucket = stats.packet_bucket(size), stats.iat_bucket(iat)
    total = F.max if counter_mode == "cumulative" else F.sum

    def counted(name: str, more: Column | None = None) -> Column:
        value = F.col(name) + (more.cast("long") if more is not None else F.lit(0))
        return F.coalesce(total(F.when(own, value)), F.lit(0)).alias(name)

    def latest(name: str, when: Column) -> Column:
        return F.max_by(F.col(name), F.when(head & when, order)).alias(name)

    client = ~flow & ((F.col("ja4") != "") | F.col("handshake_seen"))
    server = ~flow & ((F.col("ja4s") != "") | F.col("server_hello_seen"))
    aggregates = [
        F.min(F.when(own, F.col("timestamp_ns"))).alias("start_ns"),
        F.max_by("timestamp_ns", F.when(own, order)).alias("last_ns"),
        F.sum(own.cast("long")).alias("event_count"),
        F.max(F.when(own & (kind == "CLOSE"), 1).otherwise(0)).alias("closed"),
        F.max_by("close_reason", F.when(own & (kind == "CLOSE"), order)).alias("raw_reason"),
        F.max_by("tcp_state", F.when(own & (F.col("tcp_state") != ""), order)).alias("tcp_state"),
        F.min_by("cgroup_id", F.when(own, order)).alias("cgroup_id"),
        F.min_by("netns_ino", F.when(own, order)).alias("netns_ino"),
        F.min_by("node_name", F.when(own, order)).alias("node_name"),
        *[F.coalesce(F.max(F.when(own, F.col(a))), F.lit(0)).alias(b) for a, b in (("bytes_sent", "bytes_out"), ("bytes_recv", "bytes_in"), ("packets_sent", "packets_out"), ("packets_recv", "packets_in"))],
        counted("direction_changes"), counted("syn_count", kind.isin("CONNECT", "ACCEPT")), counted("fin_count", kind == "CLOSE"), counted("rst_count"), counted("retrans_count"),
        counted("idle_gap_count"), counted("burst_count"),
        F.max_by("rtt_estimate_us", F.when(own & (F.col("rtt_estimate_us") > 0), order)).alias("rtt_estimate_us"),
        *[F.coalesce(F.bool_or(F.when(own, F.col(c))), F.lit(False)).alias(c) for c in ("traffic_accounting_available", "packet_timing_available", "tcp_metrics_available")],
        F.array(*[F.coalesce(total(F.when(own, _histogram("packet_size_histogram", b))), F.lit(0)) for b in PACKET_BUCKETS]).alias("__reported_sizes"),
        F.array(*[F.coalesce(total(F.when(own, _histogram("iat_histogram", b))), F.lit(0)) for b in IAT_BUCKETS]).alias("__reported_iats"),
        F.array(*[F.count_if(size_bucket == k) for k in range(7)]).alias("__raw_sizes"),
        F.array(*[F.count_if(iat_bucket == k) for k in range(6)]).alias("__raw_iats"),
        _added(F.collect_list(F.when(own, _other_labels(F.col("packet_size_histogram"), PACKET_BUCKETS)))).alias("__other_sizes"),
        F.least(F.min(size), F.min(F.when(own, F.col("pkt_size_min")))).alias("pkt_size_min"),
        F.greatest(F.max(size), F.max(F.when(own, F.col("pkt_size_max")))).alias("pkt_size_max"),
        F.avg(size).alias("__mean"), F.percentile(size, F.lit(0.5)).alias("__p50"), F.percentile(size, F.lit(0.95)).alias("__p95"),
        F.percentile(iat, F.lit(0.5)).alias("__i50"), F.percentile(iat, F.lit(0.95)).alias("__i95"), F.stddev_pop(iat).alias("__istd"),
        F.count_if(iat > 1_000_000).alias("__idle"), F.count_if((iat > 0) & (iat < 10_000)).alias("__burst"),
        F.coalesce(F.bool_or(F.when(head & client, F.col("handshake_seen"))), F.lit(False)).alias("handshake_seen"),
        F.coalesce(F.bool_or(F.when(head & server, F.col("server_hello_seen"))), F.lit(False)).alias("server_hello_seen"),
        *[latest(c, client) for c in TLS_CLIENT], *[latest(c, server) for c in TLS_SERVER],
    ]
    return finished(x.groupBy(*by).agg(*aggregates), long_lived_ns, flush_ns, closing)


def finished(g: DataFrame, long_lived_ns: int, flush_ns: int | Column | None, closing: bool | Column) -> DataFrame:
    """Rates, ratios, estimates and names from the sums of a group. flush_ns, closing: see summarise; a column where rows differ."""
    ended = F.col("closed") == 1
    flush = F.coalesce(flush_ns if isinstance(flush_ns, Column) else F.lit(flush_ns).cast("long"), F.col("last_ns"))
    closes = closing if isinstance(closing, Column) else F.lit(closing)
    end = F.when(closes & ~ended, flush).otherwise(F.col("last_ns"))
    reason = F.when(~closes, "").when(ended, text.close_reason(F.col("raw_reason"), "unknown")).otherwise("timeout")
    g = g.withColumns({"end_ns": end, "close_reason": reason})
    duration = F.col("end_ns") - F.col("start_ns")
    g = g.withColumns({f"__{x}": F.zip_with(f"__reported_{x}", f"__raw_{x}", lambda a, b: a + b) for x in ("sizes", "iats")})
    sizes, times = F.col("__sizes"), F.col("__iats")
    some = lambda x: F.exists(f"__reported_{x}", lambda n: n > 0)
    low, high = F.col("pkt_size_min"), F.col("pkt_size_max")
    sized = lambda estimate, exact: F.when(some("sizes"), stats.clamp(estimate, low, high)).otherwise(F.col(exact))
    timed = lambda p, exact: F.when(some("iats"), stats.histogram_percentile(times, IAT_BOUNDS, p)).otherwise(F.col(exact))
    key = F.concat_ws("|", "protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    bytes_total, packets_total = F.col("bytes_out") + F.col("bytes_in"), F.col("packets_out") + F.col("packets_in")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = {
        "flow_id": F.sha1(F.concat_ws("|", key, F.col("start_ns"))),
        "duration_ms": F.floor(duration / 1_000_000).cast("long"),
        "bytes_total": bytes_total, "packets_total": packets_total,
        "byte_ratio_out_in": stats.safe_ratio(F.col("bytes_out"), F.col("bytes_in")), "packet_ratio_out_in": stats.safe_ratio(F.col("packets_out"), F.col("packets_in")),
        "byte_rate": stats.rate(bytes_total, duration), "packet_rate": stats.rate(packets_total, duration),
        "pkt_size_mean": sized(stats.histogram_mean(sizes, PACKET_BOUNDS), "__mean"),
        "pkt_size_p50": sized(stats.histogram_percentile(sizes, PACKET_BOUNDS, 0.5), "__p50"), "pkt_size_p95": sized(stats.histogram_percentile(sizes, PACKET_BOUNDS, 0.95), "__p95"),
        "pkt_size_histogram": F.map_concat(stats.as_map(sizes, PACKET_BUCKETS), F.col("__other_sizes")) if "__other_sizes" in g.columns else stats.as_map(sizes, PACKET_BUCKETS),
        "iat_p50": timed(0.5, "__i50"), "iat_p95": timed(0.95, "__i95"), "iat_std": F.when(~some("iats"), F.col("__istd")),
        "idle_gap_count": F.col("idle_gap_count") + F.col("__idle"), "burst_count": F.col("burst_count") + F.col("__burst"),
        "is_long_lived": duration >= (long_lived_ns if long_lived_ns > 0 else DEFAULTS["long_lived_ns"]),
        "tcp_state": empty("tcp_state"), "ip_family": net.ip_family(F.col("src_ip"), F.col("dst_ip")), "base_direction": net.base_direction(F.col("src_ip"), F.col("dst_ip")),
    } | {c: empty(c) for c in (*TLS_CLIENT, *TLS_SERVER)}
    # sums of histogram buckets feed several columns: keep them in one projection
    made = g.select(*[c for c in g.columns if c not in out and not c.startswith("__") and c not in ("raw_reason", "last_ns")], *[v.alias(k) for k, v in out.items()])
    return made.where("event_count > 0")


def sessions(events: DataFrame, long_lived_ns: int = DEFAULTS["long_lived_ns"], flush_ns: int | None = None, timeout_ns: int | None = None, keys: list[str] | None = None, counter_mode: str = "event") -> DataFrame:
    """Session summaries: closed ones, and open ones ended at flush_ns (null: their last event). timeout_ns: see number_sessions."""
    keys = keys or KEY
    out = summarise(number_sessions(events, keys, timeout_ns), [*keys, "session_no"], long_lived_ns, flush_ns, True, keys, counter_mode)
    return out.withColumns({"window_id": F.lit(0), "record_type": F.lit("session_summary")})


def window_summaries(events: DataFrame, window_ns: int = DEFAULTS["window_ns"], long_lived_ns: int = DEFAULTS["long_lived_ns"], keys: list[str] | None = None) -> DataFrame:
    """Window summaries: cumulative from the session's start to each emission.

    The events between two emissions are a segment. Segments are summed each by itself and then along their session, so an event
    is summed once, however many windows follow it. Percentiles are rank queries on the counts of sample values (prefix_ranks).
    """
    keys = keys or KEY
    by, scratch = [*keys, "session_no"], ("matched", "emitted", "windows", "windows_before")
    gated = window_gates(number_sessions(events, keys), window_ns, keys).where("matched AND windows_before < windows")
    rows = stored(gated.withColumn("window_id", F.col("windows_before") + 1).drop(*scratch), "windowed")
    order, flow, kind = F.struct("timestamp_ns", "seq"), F.col("event_type") != "TLS_HANDSHAKE", F.col("event_type")
    client = ~flow & ((F.col("ja4") != "") | F.col("handshake_seen"))
    server = ~flow & ((F.col("ja4s") != "") | F.col("server_hello_seen"))
    at = lambda name, when: F.when(when, F.struct(order.alias("at"), F.col(name).alias("v")))
    last = {"last_ns": at("timestamp_ns", flow), "raw_reason": at("close_reason", flow & (kind == "CLOSE")), "tcp_state": at("tcp_state", flow & (F.col("tcp_state") != "")), "rtt_estimate_us": at("rtt_estimate_us", flow & (F.col("rtt_estimate_us") > 0))}
    last |= {c: at(c, client) for c in TLS_CLIENT} | {c: at(c, server) for c in TLS_SERVER}
    first = {c: at(c, flow) for c in ("cgroup_id", "netns_ino", "node_name")}
    own = lambda c: F.when(flow, F.col(c))
    most = {"bytes_out": own("bytes_sent"), "bytes_in": own("bytes_recv"), "packets_out": own("packets_sent"), "packets_in": own("packets_recv"), "closed": (flow & (kind == "CLOSE")).cast("int"), "__high": F.greatest(own("pkt_size_max"), F.array_max("packet_sizes"))}
    most |= {c: F.when(flow, F.col(c)) for c in ("traffic_accounting_available", "packet_timing_available", "tcp_metrics_available")} | {"handshake_seen": F.when(client, F.col("handshake_seen")), "server_hello_seen": F.when(server, F.col("server_hello_seen"))}
    least = {"start_ns": own("timestamp_ns"), "__low": F.least(own("pkt_size_min"), F.array_min("packet_sizes"))}
    total = {"event_count": flow.cast("long"), "syn_count": F.when(flow, F.col("syn_count") + kind.isin("CONNECT", "ACCEPT").cast("long")), "fin_count": F.when(flow, F.col("fin_count") + (kind == "CLOSE").cast("long"))}
    total |= {c: own(c) for c in ("direction_changes", "rst_count", "retrans_count", "idle_gap_count", "burst_count")}
    total |= {f"__p{k}": F.when(flow, _histogram("packet_size_histogram", b)) for k, b in enumerate(PACKET_BUCKETS)} | {f"__i{k}": F.when(flow, _histogram("iat_histogram", b)) for k, b in enumerate(IAT_BUCKETS)}
    samples = stored(window_samples(rows, by), "samples")
    sums = sample_sums()
    kinds = [(total, F.sum), (most, F.max), (last, F.max), (least, F.min), (first, F.min), (sums, F.sum)]
    segments = rows.groupBy(*by, "window_id").agg(*[f(v).alias(c) for some, f in kinds if some is not sums for c, v in some.items()])
    segments = segments.join(samples.groupBy(*by, "window_id").agg(*[F.sum(v).alias(c) for c, v in sums.items()]), [*by, "window_id"], "left")
    along = Window.partitionBy(*by).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = stored(segments.select(*by, "window_id", *[f(c).over(along).alias(c) for some, f in kinds for c in some]), "windows")
    whole = whole.join(prefix_percentiles(whole, samples, by), [*by, "window_id"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    mean = lambda s, n: F.col(s).cast("double") / F.nullif(F.col(n), F.lit(0))
    squares = F.col("__ng").cast("decimal(18,0)") * F.col("__qg") - F.col("__sg").cast("decimal(19,0)") * F.col("__sg").cast("decimal(19,0)")
    g = whole.select(
        *by, "window_id", *[c for some in (total, most, least) for c in some if not c.startswith("__")], *[F.col(f"{c}.v").alias(c) for some in (last, first) for c in some],
        F.array(*[F.col(f"__p{k}") for k in range(7)]).alias("__reported_sizes"), F.array(*[F.col(f"__i{k}") for k in range(6)]).alias("__reported_iats"),
        F.array(*[count(f"__rp{k}") for k in range(7)]).alias("__raw_sizes"), F.array(*[count(f"__ri{k}") for k in range(6)]).alias("__raw_iats"),
        F.col("__low").alias("pkt_size_min"), F.col("__high").alias("pkt_size_max"), mean("__ss", "__ns").alias("__mean"), "__p50", "__p95", "__i50", "__i95",
        F.when(F.col("__ng") > 0, F.sqrt(squares.cast("double")) / F.col("__ng")).alias("__istd"), count("__idle").alias("__idle"), count("__burst").alias("__burst"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in (*total, "bytes_out", "bytes_in", "packets_out", "packets_in") if not c.startswith("__")}
    false = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("traffic_accounting_available", "packet_timing_available", "tcp_metrics_available", "handshake_seen", "server_hello_seen")}
    out = finished(g.withColumns(zero | false), long_lived_ns, None, False)
    return out.withColumn("record_type", F.lit("window_summary"))


SAMPLE_KINDS = {"s": "packet_sizes", "g": "iat_us"}


def window_samples(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, window_id, kind (s: sizes, g: gaps), value, n: how often each segment has a value."""
    of_kind = lambda k: lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    each = F.concat(*[F.transform(c, of_kind(k)) for k, c in SAMPLE_KINDS.items()])
    return rows.select(*by, "window_id", F.explode(each).alias("x")).groupBy(*by, "window_id", "x.kind", "x.value").agg(F.count("*").alias("n"))


def sample_sums() -> dict[str, Column]:
    """What sums of samples a segment needs: numbers, totals, squares of gaps, bucket counts, idle gaps and bursts."""
    v, n, size, gap = F.col("value"), F.col("n"), F.col("kind") == "s", F.col("kind") == "g"
    square = (v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)")
    out = {"__ns": F.when(size, n), "__ss": F.when(size, n * v), "__ng": F.when(gap, n), "__sg": F.when(gap, n * v), "__qg": F.when(gap, (n.cast("decimal(10,0)") * square).cast("decimal(38,0)"))}
    out |= {f"__rp{k}": F.when(size & (stats.packet_bucket(v) == k), n) for k in range(7)} | {f"__ri{k}": F.when(gap & (stats.iat_bucket(v) == k), n) for k in range(6)}
    return out | {"__idle": F.when(gap & (v > 1_000_000), n), "__burst": F.when(gap & (v > 0) & (v < 10_000), n)}


def prefix_percentiles(whole: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """by, window_id, __p50, __p95 (sizes), __i50, __i95 (gaps): exact percentiles of the samples of a session up to each window.

    whole: windows with the numbers of samples so far (__ns, __ng); windows that add none have those of the one before.
    """
    g = F.concat("kind", F.to_json(F.array(*[F.col(c).cast("string") for c in by])))
    numbers = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"__n{k}").alias("n")) for k in SAMPLE_KINDS])
    asked = whole.select(*by, "window_id", F.explode(numbers).alias("x")).select(*by, "window_id", "x.*").where("n > 0").withColumn("g", g)
    place = {p: (F.col("n") - 1) * F.lit(p) for p in (0.5, 0.95)}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.least(F.floor(x) + 1, F.col("n") - 1)) for x in place.values()])))
    found = prefix_ranks(samples.select(g.alias("g"), F.col("window_id").alias("step"), "value", "n"), asked.select("g", F.col("window_id").alias("step"), F.explode(ranks).alias("rank")))
    values = found.groupBy("g", F.col("step").cast("int").alias("window_id")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))  # four ranks at most

    def percentile(p: float) -> Column:
        low = F.floor(place[p])
        a, b = F.col("m")[low], F.col("m")[F.least(low + 1, F.col("n") - 1)]
        return a + (b - a) * (place[p] - low)

    out = asked.join(values, ["g", "window_id"]).select(*by, "window_id", "kind", percentile(0.5).alias("a"), percentile(0.95).alias("b"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return out.groupBy(*by, "window_id").agg(of("s", "a").alias("__p50"), of("s", "b").alias("__p95"), of("g", "a").alias("__i50"), of("g", "b").alias("__i95"))


def unmatched_tls(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """TLS rows that no open session took."""
    return number_sessions(events, keys).where("event_type = 'TLS_HANDSHAKE' AND NOT matched")


def with_nat_aliases(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Server hellos under a backend's address move to its service's address where only that has an open session.

    aliases: backend_ip, backend_port, protocol, cluster_ip, service_port, alias_seq; of several of a hello's protocol (null or
    empty: tcp) the first. Adds alias: hit, miss or null.
    """
    of = net.protocol_or_tcp(F.col("protocol")).alias("__protocol")
    first = aliases.groupBy("backend_ip", "backend_port", of).agg(F.min_by(F.struct("cluster_ip", "service_port"), "alias_seq").alias("a"))
    own = number_sessions(events)
    lost = (F.col("event_type") == "TLS_HANDSHAKE") & ~F.col("matched") & F.col("server_hello_seen")
    same = (F.col("dst_ip") == F.col("backend_ip")) & (F.col("dst_port") == F.col("backend_port")) & (net.protocol_or_tcp(F.col("l.protocol")) == F.col("__protocol"))
    hellos = own.where(lost).alias("l").join(first, same, "left").select("l.*", "a")
    moved = hellos.where("a IS NOT NULL").withColumns({"dst_ip": F.col("a.cluster_ip"), "dst_port": F.col("a.service_port")}).drop("a")
    # hellos change no session's number, so only the keys that get some are numbered again
    keys = moved.select(*KEY).distinct().withColumn("__again", F.lit(True))
    rest = own.where(~lost).join(keys, KEY, "left")
    again = number_sessions(rest.where("__again").drop("__again", "session_no", "matched").unionByName(moved.drop("session_no", "matched").withColumn("__moved", F.lit(True)), allowMissingColumns=True))
    hit = F.when(F.col("__moved"), F.when(F.col("matched"), "hit").otherwise("miss"))
    out = again.withColumn("alias", hit).drop("__moved")
    none = F.lit(None).cast("string")
    out = out.unionByName(rest.where("__again IS NULL").drop("__again").withColumn("alias", none))
    return out.unionByName(hellos.where("a IS NULL").drop("a").withColumn("alias", F.lit("miss")))
