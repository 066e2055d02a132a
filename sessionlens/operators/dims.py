"""Dimension tables: latest versions, address and port lookups, owners.

Change rows carry a version; the latest one of an id holds (order of arrival doesn't matter). Deleted pods stay as tombstones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import app_protocol, container_id_from_cgroup, first_non_empty, pod_uid_from_cgroup, strip_scheme

TOMBSTONE_NS = 300 * 1_000_000_000


def latest(changes: DataFrame, *key: str, by: str = "version") -> DataFrame:
    """The row of the highest version per key (of several the first by all columns)."""
    order = Window.partitionBy(*key).orderBy(F.col(by).desc(), F.xxhash64(*[c for c in changes.columns if not dict(changes.dtypes)[c].startswith("map")]))
    return changes.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def pods_by_ip(pods: DataFrame, at_ns: int | None = None) -> DataFrame:
    """One pod per address: a live one before a tombstone, then the latest version. at_ns: tombstones older than five minutes go."""
    rows = latest(pods, "uid")
    if at_ns is not None:
        rows = rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") + TOMBSTONE_NS > at_ns))
    return one_by_ip(rows)


def one_by_ip(pods: DataFrame) -> DataFrame:
    """Of latest versions one per address: a live pod before a tombstone, then the latest version."""
    rows = pods.where("ip <> ''")
    order = Window.partitionBy("ip").orderBy(F.col("deleted_at").isNotNull(), F.col("version").desc(), "uid")
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def pods_by_uid(pods: DataFrame) -> DataFrame:
    """Live pods only."""
    return latest(pods, "uid").where("deleted_at IS NULL")


def service_ports(services: DataFrame) -> DataFrame:
    """A row per cluster address and port: cluster_ip, port, target_port, target_name, port_name, protocol, app_protocol, namespace, name, uid."""
    rows = latest(services, "uid").select("namespace", "name", "uid", F.explode("cluster_ips").alias("cluster_ip"), "ports").where("cluster_ip NOT IN ('', 'None')")
    p = rows.select("namespace", "name", "uid", "cluster_ip", F.explode("ports").alias("p"))
    protocol = F.lower(F.coalesce(F.nullif("p.protocol", F.lit("")), F.lit("tcp")))
    return p.select("namespace", "name", "uid", "cluster_ip", "p.port", "p.target_port", F.coalesce("p.target_name", F.lit("")).alias("target_name"), F.coalesce("p.name", F.lit("")).alias("port_name"), protocol.alias("protocol"), app_protocol(F.col("p.app_protocol"), F.col("p.name")).alias("app_protocol"))


def endpoint_aliases(slices: DataFrame, ports: DataFrame) -> DataFrame:
    """Backend address and port -> service: backend_ip, backend_port, protocol, target_pod_uid, service columns, alias_seq.

    A slice's port belongs to a service port of its namespace, service name, protocol and address family whose name or target
    name it has, or whose target port it is, or which it equals where there is no target. The lowest cluster address wins, then
    the lowest service port.
    """
    s = latest(slices, "uid").withColumn("alias_seq", F.col("version"))
    s = s.select("namespace", "service_name", "uid", "alias_seq", F.explode("endpoints").alias("e"), "ports")
    s = s.select("namespace", "service_name", F.col("uid").alias("slice_uid"), "alias_seq", F.col("e.target_pod_uid").alias("target_pod_uid"), F.explode("e.addresses").alias("backend_ip"), "ports")
    s = s.select("*", F.explode("ports").alias("p")).where("p.port IS NOT NULL")
    protocol = F.lower(F.coalesce(F.nullif("p.protocol", F.lit("")), F.lit("tcp")))
    s = s.select("namespace", "service_name", "slice_uid", "alias_seq", "target_pod_uid", "backend_ip", F.col("p.port").alias("backend_port"), F.coalesce("p.name", F.lit("")).alias("slice_port_name"), protocol.alias("protocol"))
    v = ports.select("namespace", F.col("name").alias("service_name"), "protocol", F.col("uid").alias("service_uid"), "cluster_ip", F.col("port").alias("service_port"), "target_port", "target_name", "port_name", "app_protocol")
    named = (F.col("slice_port_name") == F.col("port_name")) | ((F.col("target_name") != "") & (F.col("slice_port_name") == F.col("target_name")))
    no_target = (F.coalesce("target_port", F.lit(0)) == 0) & (F.col("target_name") == "")
    fits = named | (F.col("target_port") == F.col("backend_port")) | (no_target & (F.col("service_port") == F.col("backend_port")))
    family = F.col("backend_ip").contains(":") == F.col("cluster_ip").contains(":")
    joined = s.join(v, ["namespace", "service_name", "protocol"]).where(fits & family)
    order = Window.partitionBy("backend_ip", "backend_port", "protocol", "slice_uid").orderBy("cluster_ip", "service_port")
    return joined.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def first_alias(aliases: DataFrame) -> DataFrame:
    """One service per backend address, port and protocol: the alias of the lowest alias_seq."""
    order = Window.partitionBy("backend_ip", "backend_port", "protocol").orderBy("alias_seq", "slice_uid")
    return aliases.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def workload_of(pods: DataFrame, workloads: DataFrame) -> DataFrame:
    """uid, workload_kind, workload_name, workload_uid, replicaset, revision, pod_template_hash of each pod.

    The first owner of a known kind counts: a ReplicaSet leads to its Deployment, a Job to its CronJob where they are known;
    an owner that is unknown still gives kind, name and uid. Without owners the pod is its own workload (BarePod).
    """
    kinds = ("ReplicaSet", "StatefulSet", "DaemonSet", "Job")
    owner = F.get(F.filter("owners", lambda o: o["kind"].isin(*kinds)), F.lit(0))
    p = pods.select("uid", "name", "namespace", "labels", owner.alias("o"))
    own = workloads.select(F.col("uid").alias("w_uid"), F.col("kind").alias("w_kind"), F.col("name").alias("w_name"), F.col("owner_kind").alias("w_owner_kind"), F.col("owner_uid").alias("w_owner_uid"), F.col("revision").alias("w_revision"), F.col("pod_template_hash").alias("w_hash"), F.col("image").alias("w_image"))
    above = workloads.select(F.col("uid").alias("a_uid"), F.col("kind").alias("a_kind"), F.col("name").alias("a_name"), F.col("revision").alias("a_revision"))
    j = p.join(own, F.col("o.uid") == F.col("w_uid"), "left").join(above, (F.col("w_owner_uid") == F.col("a_uid")) & (F.col("w_owner_kind") == F.col("a_kind")) & F.col("a_kind").isin("Deployment", "CronJob"), "left")
    bare, up = F.col("o").isNull(), F.col("a_uid").isNotNull()
    of = lambda a, o, b: F.when(bare, b).when(up, F.col(a)).otherwise(F.col(o))
    return j.select(
        "uid",
        of("a_kind", "o.kind", F.lit("BarePod")).alias("workload_kind"), of("a_name", "o.name", F.col("name")).alias("workload_name"), of("a_uid", "o.uid", F.col("uid")).alias("workload_uid"),
        F.when(F.col("a_kind") == "Deployment", F.col("w_name")).otherwise("").alias("replicaset"),
        first_non_empty(F.when(up, F.col("a_revision")), F.col("w_revision")).alias("revision"),
        first_non_empty(F.col("w_hash"), F.try_element_at("labels", F.lit("pod-template-hash"))).alias("pod_template_hash"),
        first_non_empty(F.col("w_image")).alias("workload_image"),
    )


def cgroup_pods(cgroups: DataFrame) -> DataFrame:
    """cgroup_id, pod_uid, container_id from paths; paths without a pod go."""
    path = F.col("path")
    return cgroups.select("cgroup_id", pod_uid_from_cgroup(path).alias("pod_uid"), container_id_from_cgroup(path).alias("container_id")).where("pod_uid <> ''").dropDuplicates(["cgroup_id"])


def scan_changes(before: DataFrame, after: DataFrame, key: str = "cgroup_id") -> DataFrame:
    """What two scans of a dimension differ in: key, change (added, removed, changed) and the later scan's row (of removed ones the earlier).

    Rows of one key count once; without an earlier scan all are added. A scan that failed is no scan: don't pass it.
    """
    names = [c for c in after.columns if c != key]
    row = F.struct(*names)
    one = before.dropDuplicates([key]).select(key, row.alias("b"))
    two = after.dropDuplicates([key]).select(key, row.alias("a"))
    j = one.join(two, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return j.select(key, change.alias("change"), F.coalesce("a", "b").alias("r")).select(key, "change", "r.*")


def container_name(containers: Column, primary: Column, container_id: Column) -> Column:
    """The name of a container of a pod by its id, schemes aside; an empty id means the primary one."""
    wanted = strip_scheme(container_id)
    hit = F.get(F.filter(F.map_entries(containers), lambda e: strip_scheme(e["key"]) == wanted), F.lit(0))["value"]
    return F.when(wanted == "", primary).otherwise(F.coalesce(hit, F.lit("")))
