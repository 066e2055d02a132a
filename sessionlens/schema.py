"""Input schemas, bucket labels and defaults of flow events and dimension tables."""

from __future__ import annotations

from pyspark.sql import types as T

HISTOGRAM = T.MapType(T.StringType(), T.LongType())
_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

#: Flow events, one JSON object per line; missing keys are null here and get their zero values in normalise().
FLOW_EVENT = T.StructType(
    [T.StructField("timestamp_ns", _L), T.StructField("event_type", _S)]
    + [T.StructField(c, _L) for c in ("pid", "tgid", "cgroup_id", "netns_ino")]
    + [T.StructField("src_ip", _S), T.StructField("src_port", _I), T.StructField("dst_ip", _S), T.StructField("dst_port", _I), T.StructField("protocol", _S)]
    + [T.StructField(c, _L) for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv")]
    + [T.StructField(c, T.ArrayType(_L)) for c in ("packet_sizes", "iat_us")]
    + [T.StructField(c, HISTOGRAM) for c in ("packet_size_histogram", "iat_histogram")]
    + [T.StructField(c, _L) for c in ("pkt_size_min", "pkt_size_max", "idle_gap_count", "burst_count", "real_packets_sent", "real_packets_recv")]
    + [T.StructField(c, _L) for c in ("direction_changes", "syn_count", "fin_count", "rst_count", "retrans_count", "rtt_estimate_us")]
    + [T.StructField(c, _S) for c in ("tcp_state", "close_reason", "drop_reason")]
    + [T.StructField("drop_count", _L), T.StructField("handshake_seen", _B)]
    + [T.StructField(c, _S) for c in ("tls_version", "sni_hash", "alpn", "ja4", "tls_parse_status")]
    + [T.StructField("direction", _I), T.StructField("tls_payload_hex", _S), T.StructField("server_hello_seen", _B)]
    + [T.StructField(c, _S) for c in ("tls_version_negotiated", "alpn_negotiated", "ja4s", "tls_server_parse_status")]
    + [T.StructField(c, _B) for c in ("traffic_accounting_available", "packet_timing_available", "tcp_metrics_available")]
    + [T.StructField("node_name", _S)]
)

#: Columns whose null is a value of its own.
NULLABLE = {"pkt_size_min", "pkt_size_max"}

KEY = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]

# Labels and bounds of the packet-size (bytes) and inter-arrival (microseconds) buckets.
PACKET_BUCKETS = ["0-63", "64-127", "128-255", "256-511", "512-1023", "1024-1500", ">1500"]
PACKET_BOUNDS = [(0, 63), (64, 127), (128, 255), (256, 511), (512, 1023), (1024, 1500), (1501, 1501)]
IAT_BUCKETS = ["<100", "100-1000", "1000-10000", "10000-100000", "100000-1000000", ">1000000"]
IAT_BOUNDS = [(0, 99), (100, 1000), (1000, 10000), (10000, 100000), (100000, 1000000), (1000001, 1000001)]

SECOND = 1_000_000_000
DEFAULTS = {"session_timeout_ns": 60 * SECOND, "window_ns": 30 * SECOND, "long_lived_ns": 300 * SECOND}

OWNER = T.StructType([T.StructField(c, _S) for c in ("kind", "name", "uid")])
PODS = "namespace string, name string, uid string, ip string, node_name string, container_name string, container_id string, containers map<string,string>, image_digest string, service_account string, owners array<struct<kind:string,name:string,uid:string>>, labels map<string,string>, created_at long, deleted_at long, host_network boolean, version long"
SERVICES = "namespace string, name string, uid string, cluster_ips array<string>, ports array<struct<port:int,target_port:int,target_name:string,name:string,app_protocol:string,protocol:string>>, version long"
ENDPOINT_SLICES = "namespace string, uid string, name string, service_name string, endpoints array<struct<addresses:array<string>,target_pod_uid:string>>, ports array<struct<port:int,name:string,protocol:string>>, version long"
WORKLOADS = "kind string, namespace string, name string, uid string, owner_kind string, owner_uid string, revision string, pod_template_hash string, image string"
CGROUPS = "cgroup_id long, path string"
LABELS = "experiment_id string, scenario_label string, scenario_phase string, attack_enabled string, load_level string"
