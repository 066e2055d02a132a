"""Flow-event sources: JSON lines, kernel rows, drop counters, labels; normalised to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import dotted_little_endian, protocol_or_tcp
from ..functions.stats import counts_to_map
from ..functions.tls import client_hello, server_hello
from ..schema import FLOW_EVENT, IAT_BUCKETS, NULLABLE, PACKET_BUCKETS


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Flow events of JSON lines, in input order by (file, block, seq). strict: a bad line fails the read; else it goes to _corrupt_record.

    Blank lines are skipped and a last line without a line break counts.
    """
    schema = FLOW_EVENT if strict else T.StructType([*FLOW_EVENT.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = reader.json(path)
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))


def stream_jsonl(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(FLOW_EVENT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _zero(field: T.StructField) -> Column:
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return F.lit(0).cast(kind)


def normalise(events: DataFrame, decode_tls: bool = True) -> DataFrame:
    """Zero values for missing ones, upper-case types, tcp by default, availability from what is there; hellos are parsed and dropped.

    Columns that the input lacks are added; an ingested_ns column replaces a missing or zero timestamp.
    """
    have = set(events.columns)
    given = {f.name: F.coalesce(F.col(f.name), _zero(f)) if f.name not in NULLABLE else F.col(f.name) for f in FLOW_EVENT.fields if f.name in have}
    added = {f.name: _zero(f) if f.name not in NULLABLE else F.lit(None).cast(f.dataType) for f in FLOW_EVENT.fields if f.name not in have}
    out = events.withColumns(given | added)
    out = out.withColumns({"event_type": F.upper("event_type"), "protocol": protocol_or_tcp(F.col("protocol"))})
    if "ingested_ns" in have:
        out = out.withColumn("timestamp_ns", F.when(F.col("timestamp_ns") == 0, F.col("ingested_ns")).otherwise(F.col("timestamp_ns")))
    if decode_tls:
        out = with_tls(out)
    traffic = (F.col("bytes_sent") + F.col("bytes_recv") + F.col("packets_sent") + F.col("packets_recv")) > 0
    timing = (F.size("packet_sizes") > 0) | (F.size("iat_us") > 0) | _any(F.col("packet_size_histogram")) | _any(F.col("iat_histogram")) | F.col("pkt_size_min").isNotNull() | F.col("pkt_size_max").isNotNull()
    tcp = (F.col("tcp_state") != "") | (F.col("retrans_count") > 0) | (F.col("rst_count") > 0) | (F.col("rtt_estimate_us") > 0)
    flow = F.col("event_type") != "TLS_HANDSHAKE"
    return out.withColumns({c: F.col(c) | (x & flow) for c, x in (("traffic_accounting_available", traffic), ("packet_timing_available", timing), ("tcp_metrics_available", tcp))})


def _any(histogram: Column) -> Column:
    return F.exists(F.map_values(histogram), lambda n: n > 0)


def with_tls(events: DataFrame) -> DataFrame:
    """Payloads of TLS_HANDSHAKE rows become columns; direction 2 is a server's hello. A payload that isn't hex is a parse error."""
    known = (F.col("event_type") == "TLS_HANDSHAKE") & (F.col("tls_payload_hex") != "")
    digits = F.col("tls_payload_hex").rlike("^([0-9A-Fa-f]{2})+$")
    raw = F.when(known & digits, F.unhex("tls_payload_hex"))
    server = known & (F.col("direction") == 2)
    client = known & (F.col("direction") != 2)
    out = events.withColumn("__c", F.when(client, client_hello(F.when(client, raw)))).withColumn("__s", F.when(server, server_hello(F.when(server, raw))))
    names = {"handshake_seen": ("__c", "handshake_seen"), "tls_version": ("__c", "version"), "sni_hash": ("__c", "sni_hash"), "alpn": ("__c", "alpn"), "ja4": ("__c", "fingerprint"), "tls_parse_status": ("__c", "status")}
    names |= {"server_hello_seen": ("__s", "handshake_seen"), "tls_version_negotiated": ("__s", "version"), "alpn_negotiated": ("__s", "alpn"), "ja4s": ("__s", "fingerprint"), "tls_server_parse_status": ("__s", "status")}
    of = lambda s, f: F.when(~digits, "parse_error").otherwise(F.col(f"{s}.status")) if f == "status" else F.col(f"{s}.{f}")
    out = out.withColumns({c: F.when(client if s == "__c" else server, of(s, f)).otherwise(F.col(c)) for c, (s, f) in names.items()})
    return out.withColumn("tls_payload_hex", F.lit("")).drop("__c", "__s")


def without_features(events: DataFrame, sizes: bool = True, timing: bool = True) -> DataFrame:
    """Feature switches: without sizes or timing their columns are empty, and the scan doesn't read them."""
    off = {}
    if not sizes:
        off |= {"packet_sizes": F.array().cast("array<bigint>"), "packet_size_histogram": F.lit(None).cast("map<string,bigint>"), "pkt_size_min": F.lit(None).cast("long"), "pkt_size_max": F.lit(None).cast("long")}
    if not timing:
        off |= {"iat_us": F.array().cast("array<bigint>"), "iat_histogram": F.lit(None).cast("map<string,bigint>"), "idle_gap_count": F.lit(0).cast("long"), "burst_count": F.lit(0).cast("long")}
    return events.withColumns(off) if off else events


def kernel_rows(rows: DataFrame) -> DataFrame:
    """Decoded kernel rows (code, family, proto, 32-bit addresses, counters, bucket arrays) as flow events.

    Codes 1 to 4 are CONNECT, CLOSE, STATS, DROP; other codes, families than IPv4 (2) and protocols than TCP (6) go.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for k in enumerate(("CONNECT", "CLOSE", "STATS", "DROP"), 1) for x in k]), F.col("code"))
    kept = rows.where("family = 2 AND proto = 6 AND code BETWEEN 1 AND 4").withColumn("event_type", kind)
    out = kept.withColumns({"src_ip": dotted_little_endian(F.col("src_addr")), "dst_ip": dotted_little_endian(F.col("dst_addr")), "protocol": F.lit("tcp"), "pkt_size_min": F.nullif("size_min", F.lit(0)), "pkt_size_max": F.nullif("size_max", F.lit(0))})
    out = out.withColumns({"packet_size_histogram": counts_to_map(F.col("size_counts"), PACKET_BUCKETS), "iat_histogram": counts_to_map(F.col("iat_counts"), IAT_BUCKETS)})
    state = F.when(F.col("event_type") == "CONNECT", "established").when(F.col("event_type") == "CLOSE", "close").otherwise("")
    return out.withColumns({"tcp_state": state, "close_reason": F.when(F.col("event_type") == "CLOSE", "unknown").otherwise("")}).drop("code", "family", "proto", "src_addr", "dst_addr", "size_min", "size_max", "size_counts", "iat_counts")


_RECORD = [("timestamp_ns", 8), ("cgroup_id", 8), ("netns_ino", 8), ("code", 4), ("src_addr", 4), ("dst_addr", 4), ("src_port", 2), ("dst_port", 2), ("length", 4)]


MOST_PAYLOAD = 1024


def little_endian(record: Column, at: int, size: int) -> Column:
    """The integer of so many bytes from place at (0 the first); eight bytes over 2 ** 63 come as a negative one."""
    digits = F.regexp_replace(F.reverse(F.hex(F.substring(record, at + 1, size))), "(.)(.)", "$2$1")
    return F.conv(digits, 16, -10 if size == 8 else 10).cast("long")


def captures(rows: DataFrame, record: str = "record") -> DataFrame:
    """Binary TLS captures as TLS_HANDSHAKE events; normalise() parses them. Direction 2 is the server's.

    Little-endian records: fixed fields, then up to 1024 payload bytes of which length counts. Null and short records go.
    """
    head, places, at = sum(n for _, n in _RECORD), {}, 0
    for name, n in _RECORD:
        places[name], at = (at, n), at + n
    field = {name: little_endian(F.col(record), *place) for name, place in places.items()}
    payload = F.expr(f"substring(`{record}`, {head + 1}, cast(least(__length, {MOST_PAYLOAD}) as int))")
    d = rows.where(F.octet_length(record) >= head).withColumn("__length", field["length"])
    return d.select(
        *[field[c].alias(c) for c in ("timestamp_ns", "cgroup_id", "netns_ino")], field["code"].cast("int").alias("direction"), *[field[c].cast("int").alias(c) for c in ("src_port", "dst_port")],
        dotted_little_endian(field["src_addr"]).alias("src_ip"), dotted_little_endian(field["dst_addr"]).alias("dst_ip"),
        F.lit("TLS_HANDSHAKE").alias("event_type"), F.hex(payload).alias("tls_payload_hex"),
    )


def drop_deltas(readings: DataFrame, reason: str = "reason", at: str = "ts", total: str = "total", source: list[str] | None = None) -> DataFrame:
    """DROP rows from cumulative counters: the difference to the reading before; unchanged counters give none."""
    order = Window.partitionBy(*(source or []), reason).orderBy(at)
    delta = F.col(total) - F.coalesce(F.lag(total).over(order), F.lit(0))
    return readings.withColumn("drop_count", delta).where("drop_count <> 0").withColumns({"event_type": F.lit("DROP"), "drop_reason": F.col(reason)})


def union_streams(*streams: DataFrame) -> DataFrame:
    """Flow, TLS and drop events as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def current_labels(reads: DataFrame, at: str = "read_at", document: list[str] | None = None) -> DataFrame:
    """Experiment labels at every read of a document: failed reads (ok false) keep its last good ones; before the first good one the defaults. Without document the reads are those of one."""
    document = document or []
    order = Window.partitionBy(*document).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    names = ["experiment_id", "scenario_label", "scenario_phase", "attack_enabled", "load_level"]
    default = {"experiment_id": "unknown", "scenario_label": "unlabeled"}
    held = F.last(F.when(F.col("ok"), F.struct(*names)), ignorenulls=True).over(order)
    return reads.withColumn("__l", held).select(*document, at, *[F.coalesce(F.nullif(F.col(f"__l.{c}"), F.lit("")), F.lit(default.get(c, ""))).alias(c) for c in names])
