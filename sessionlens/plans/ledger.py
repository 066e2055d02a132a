"""The flat session record and its sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import net, stats
from ..functions.text import first_non_empty, rfc3339
from .rotation import write_rotated

# Fixed values of the record format.
SCHEMA_VERSION = "v1alpha2"
REASONS = ["CROSS_NAMESPACE", "EXTERNAL_DESTINATION", "LONG_LIVED", "UNKNOWN_IDENTITY", "ROLLOUT_WINDOW", "VISIBILITY_DEGRADED"]


def non_empty_equal(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (a == b), F.lit(False))


def reason_codes(*flags: Column) -> Column:
    """The names of the flags that are true, in the order of REASONS."""
    return F.array_compact(F.array(*[F.when(f, name) for f, name in zip(flags, REASONS, strict=True)]))


# What each collection mode hooks into.
HOOKS = {"mock": "mock", "ebpf": "tracepoint:sock:inet_sock_set_state"}


def hook_source(mode: str) -> str:
    return HOOKS.get(mode, "unknown")


def agent_id(agent: str = "", node: str = "", host: str = "") -> str:
    """The given name, else node/host; one of both where they are the same or the other is missing."""
    names = list(dict.fromkeys(x for x in (node, host) if x))
    return agent or "/".join(names)


def sampling_rate(context: dict[str, str]) -> float:
    """The given rate; absent ones and those not above 0 mean all."""
    rate = float(context.get("sampling_rate") or 0)
    return rate if rate > 0 else 1.0


def ledger_record(resolved: DataFrame, labels: dict[str, str] | None = None, context: dict[str, str] | None = None) -> DataFrame:
    """144 columns per session or window summary. resolved: identity.resolve() rows; labels, context: constants of the run."""
    labels, context = labels or {}, context or {}
    c, lit = F.col, F.lit
    text = lambda v: lit(v or "")
    guess, like = net.protocol_guess(c("protocol"), c("dst_port")), net.is_tls_like(c("protocol"), c("dst_port"))
    cross = (c("src.namespace") != "") & (c("dst.namespace") != "") & (c("src.namespace") != c("dst.namespace"))
    no_tls = like & ~c("handshake_seen")
    degraded = ~c("traffic_accounting_available") | no_tls
    base = resolved.withColumns({"__guess": guess, "__like": like, "__cross": F.coalesce(cross, lit(False)), "__no_tls": no_tls, "__degraded": degraded})
    unknown = (c("src_confidence") == "unknown") | (c("dst_confidence") == "unknown")
    codes = reason_codes(c("__cross"), c("dst_external"), c("is_long_lived"), unknown, lit(False), c("__degraded"))
    base = base.withColumn("__codes", codes)
    reason = F.concat_ws(",", F.when(~c("traffic_accounting_available"), "traffic_accounting_unavailable"), F.when(c("__no_tls"), "tls_metadata_unavailable"))
    start, end = rfc3339(c("start_ns")), rfc3339(c("end_ns"))
    node = F.coalesce(c("node_name"), lit(""))
    null = lit(None).cast("double")
    side = lambda s: [
        c(f"{s}.namespace").alias(f"{s}_namespace"), c(f"{s}.pod_name").alias(f"{s}_pod_name"), c(f"{s}.pod_uid").alias(f"{s}_pod_uid"), c(f"{s}.node").alias(f"{s}_node"),
        c(f"{s}.container_name").alias(f"{s}_container_name"), c(f"{s}.container_id").alias(f"{s}_container_id"), (c("cgroup_id") if s == "src" else lit(0).cast("long")).alias(f"{s}_cgroup_id"),
        c(f"{s}.workload_kind").alias(f"{s}_workload_kind"), c(f"{s}.workload_name").alias(f"{s}_workload_name"), c(f"{s}.workload_uid").alias(f"{s}_workload_uid"), c(f"{s}.replicaset").alias(f"{s}_replicaset"),
        c(f"{s}.pod_template_hash").alias(f"{s}_pod_template_hash"), c(f"{s}.service_account").alias(f"{s}_service_account"), c(f"{s}.revision").alias(f"{s}_revision"), c(f"{s}.image_digest").alias(f"{s}_image_digest"),
    ]
    return base.select(
        # record
        lit(SCHEMA_VERSION).alias("schema_version"), "record_type", text(context.get("cluster_id")).alias("cluster_id"), node.alias("node_name"), text(context.get("agent_id")).alias("agent_id"),
        lit(context.get("collection_mode") or "unknown").alias("collection_mode"), lit(context.get("hook_source") or "unknown").alias("hook_source"),
        start.alias("start_time"), end.alias("end_time"), lit(labels.get("experiment_id") or "unknown").alias("experiment_id"), lit(labels.get("scenario_label") or "unlabeled").alias("scenario_label"),
        # lifecycle
        "flow_id", c("window_id").cast("long").alias("window_id"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", net.direction(c("base_direction"), c("src_external"), c("dst_external")).alias("direction"), "ip_family",
        start.alias("conn_start_time"), end.alias("conn_end_time"), "duration_ms", first_non_empty(c("tcp_state"), lit("unknown")).alias("tcp_state"), first_non_empty(c("close_reason"), lit("unknown")).alias("close_reason"), "is_long_lived", "netns_ino",
        # traffic
        "bytes_out", "bytes_in", "packets_out", "packets_in", "bytes_total", "packets_total", "byte_ratio_out_in", "packet_ratio_out_in", "direction_changes",
        "pkt_size_min", "pkt_size_max", "pkt_size_mean", "pkt_size_p50", "pkt_size_p95", "pkt_size_histogram", "iat_p50", "iat_p95", "iat_std", "idle_gap_count", "burst_count", "byte_rate", "packet_rate",
        "syn_count", "fin_count", "rst_count", "retrans_count", "rtt_estimate_us", "traffic_accounting_available", "packet_timing_available", "tcp_metrics_available",
        # protocol and visibility
        c("__guess").alias("protocol_guess"), c("__like").alias("is_tls_like"), "tls_version", "sni_hash", "alpn", "ja4", first_non_empty(c("tls_parse_status"), lit("not_inspected")).alias("tls_parse_status"),
        stats.empty_packet_histogram().alias("tls_record_size_histogram"), "handshake_seen", "server_hello_seen", "tls_version_negotiated", "alpn_negotiated", "ja4s", first_non_empty(c("tls_server_parse_status"), lit("not_inspected")).alias("tls_server_parse_status"),
        lit("unknown").alias("sni_visibility"), c("__degraded").alias("visibility_degraded"), reason.alias("visibility_degraded_reason"),
        # sampling
        lit(False).alias("sampling_applied"), lit(sampling_rate(context)).alias("sampling_rate"), lit("none").alias("sampling_reason"), lit(False).alias("histogram_truncated"), lit(False).alias("iat_overflow"),
        # endpoints
        *side("src"), *side("dst"), c("src_confidence").alias("src_mapping_confidence"), c("dst_confidence").alias("dst_mapping_confidence"), "mapping_method",
        c("dst_service.name").alias("dst_service_name"), c("dst_service.uid").alias("dst_service_uid"), c("dst_service.namespace").alias("dst_service_namespace"), c("dst_service.port_name").alias("dst_service_port_name"), c("dst_service.app_protocol").alias("dst_app_protocol"),
        ((c("dst_service.name") != "") & (c("dst.pod_name") != "")).alias("dst_is_service_backend"), "dst_external",
        non_empty_equal(c("src.namespace"), c("dst.namespace")).alias("same_namespace"), non_empty_equal(c("src.workload_uid"), c("dst.workload_uid")).alias("same_workload"), c("__cross").alias("cross_namespace"),
        lit("unknown").alias("expected_edge"), lit("unknown").alias("network_policy_allowed"), lit("unknown").alias("policy_confidence"), lit(False).alias("rollout_window"), lit(False).alias("hpa_scaling_window"), (node == "").alias("node_visibility_degraded"),
        # review
        lit(context.get("feature_set_version") or "session-features-v1").alias("feature_set_version"), lit("none").alias("fast_model_version"), null.alias("fast_score"), null.alias("fast_threshold"), c("__codes").alias("reason_codes"), (F.size("__codes") > 0).alias("review_required"),
        lit("").alias("review_id"), null.alias("review_score"), lit("unknown").alias("review_verdict"), lit("observe").alias("action_suggestion"), lit("standard").alias("retention_tier"), lit(False).alias("payload_collected"),
        # scenario; absent ones are null
        *[lit(labels.get(k) or None).cast("string").alias(k) for k in ("scenario_phase", "attack_enabled", "load_level")], "pod_restart_window",
    )


def write_ledger(records: DataFrame, path: str, rows_per_file: int = 0, partition_by: list[str] | None = None, max_bytes: int = 0, max_age_ns: int = 0, at: str | None = None) -> None:
    """Append as JSON lines with nulls kept; files rotate after rows_per_file records, or by size and age (rotation.write_rotated).

    at: the column (ns) whose differences are a file's age.
    """
    if max_bytes or max_age_ns:
        write_rotated(as_lines(records, at), path, max_bytes, max_age_ns, at="at" if at else None)
        return
    writer = records.write.mode("append").option("ignoreNullFields", "false")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def as_lines(records: DataFrame, at: str | None = None) -> DataFrame:
    """value: a record as JSON with nulls kept; at, where it is named, which is no part of the record."""
    kept = [F.col(c) for c in records.columns if c != at]
    line = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value")
    return records.select(line, *([F.col(at).alias("at")] if at else []))


def stream_rotated_ledger(records: DataFrame, path: str, checkpoint: str, max_bytes: int, max_age_ns: int = 0, at: str | None = None, trigger: str | None = None) -> StreamingQuery:
    """A stream of records in rotated files, by micro-batch; a retried one takes the place of its first try."""

    def write(batch: DataFrame, number: int) -> None:
        write_rotated(as_lines(batch, at), f"{path}/batch={number}", max_bytes, max_age_ns, at="at" if at else None, mode="overwrite")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_ledger(records: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append a stream of records; the checkpoint makes files appear once. Without a trigger interval what is available is written."""
    writer = records.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
