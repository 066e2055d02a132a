"""Operational counters as aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame) -> DataFrame:
    """metric, label, value: events by type, hello parses by status, drops by reason."""
    kinds = events.groupBy(F.lit("events").alias("metric"), F.col("event_type").alias("label")).agg(F.count("*").alias("value"))
    status = F.when(F.col("direction") == 2, F.col("tls_server_parse_status")).otherwise(F.col("tls_parse_status"))
    hellos = events.where("event_type = 'TLS_HANDSHAKE'").groupBy(F.lit("tls_parse").alias("metric"), F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")).alias("label")).agg(F.count("*").alias("value"))
    drops = events.where("event_type = 'DROP'").groupBy(F.lit("drops").alias("metric"), F.coalesce(F.nullif("drop_reason", F.lit("")), F.lit("unknown")).alias("label")).agg(F.sum("drop_count").alias("value"))
    return kinds.unionByName(hellos).unionByName(drops)


def record_counts(records: DataFrame) -> DataFrame:
    """emitted, unknown_src, unknown_dst, external_dst, reviews: one row."""
    return records.agg(F.count("*").alias("emitted"), F.count_if(F.col("src_mapping_confidence") == "unknown").alias("unknown_src"), F.count_if(F.col("dst_mapping_confidence") == "unknown").alias("unknown_dst"), F.count_if("dst_external").alias("external_dst"), F.count_if("review_required").alias("reviews"))


def dimension_sizes(pods: DataFrame, ports: DataFrame, slices: DataFrame, cgroups: DataFrame) -> DataFrame:
    """metric, value: live pods, distinct services, endpoint slices, cgroups, service accounts."""
    rows = [
        pods.where("deleted_at IS NULL").agg(F.countDistinct("uid").alias("value")).withColumn("metric", F.lit("pods")),
        ports.agg(F.countDistinct("uid").alias("value")).withColumn("metric", F.lit("services")),
        slices.agg(F.countDistinct("uid").alias("value")).withColumn("metric", F.lit("endpoint_slices")),
        cgroups.agg(F.countDistinct("cgroup_id").alias("value")).withColumn("metric", F.lit("cgroups")),
        pods.agg(F.countDistinct("namespace", "service_account").alias("value")).withColumn("metric", F.lit("service_accounts")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def alias_counts(resolved: DataFrame) -> DataFrame:
    """alias (hit, miss), n: how server hellos without a session of their own fared."""
    return resolved.where("alias IS NOT NULL").groupBy("alias").agg(F.count("*").alias("n"))
