"""Who the endpoints of a session are: priority-ordered lookups in small dimension tables.

Dimensions are broadcast after a size check and joined by shuffle beyond it; the plan is the same otherwise. Addresses are looked up as
of a flow's start, in the intervals in which pods have them: few intervals are broadcast, many are merged with the flows in order
of time. A table of states instead of a log has one interval for each address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.text import first_non_empty
from ..storage import stored
from . import dims, history

FIELDS = ["namespace", "pod_name", "pod_uid", "node", "container_name", "container_id", "workload_kind", "workload_name", "workload_uid", "replicaset", "pod_template_hash", "service_account", "revision", "image_digest"]
#: Dimension tables of at most so many rows are broadcast.
BROADCAST_ROWS = 200_000
#: Addresses that at most so many pod versions had are joined by range where the dimensions are broadcast.
GENERATIONS = 64
#: Time buckets in which flows and intervals of an address meet otherwise.
BUCKET_NS = 3_600 * 1_000_000_000
RESTART_NS = 300 * 1_000_000_000


def fits(*tables: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether all have few rows; counted up to the limit only. A lookup has no more rows than the tables it comes from."""
    return all(t.limit(limit + 1).count() <= limit for t in tables)


def small(df: DataFrame, yes: bool) -> DataFrame:
    return F.broadcast(df) if yes else df


def pod_identities(pods: DataFrame, workloads: DataFrame) -> DataFrame:
    """pod row (latest versions) -> struct of FIELDS (container fields: the primary container) with what lookups need of the pod."""
    w = dims.workload_of(pods, workloads)
    j = pods.join(w, "uid")
    ident = F.struct(
        F.col("namespace"), F.col("name").alias("pod_name"), F.col("uid").alias("pod_uid"), F.col("node_name").alias("node"), F.col("container_name"), F.col("container_id"),
        "workload_kind", "workload_name", "workload_uid", "replicaset", "pod_template_hash", F.col("service_account"), "revision", first_non_empty(F.col("image_digest"), F.col("workload_image")).alias("image_digest"),
    )
    return j.select("uid", "ip", "version", ident.alias("ident"), "created_at", "deleted_at", "host_network", "containers", "container_name")


def _empty() -> Column:
    return F.struct(*[F.lit("").alias(c) for c in FIELDS])


def few_generations(pods: DataFrame, limit: int = GENERATIONS) -> bool:
    most = pods.groupBy("ip").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= limit


@dataclass
class Pods:
    """What both sides of a flow need of the pods: identities of the latest versions, intervals of their addresses, and their sizes."""

    known: DataFrame
    held: DataFrame
    fits: bool
    few: bool


def prepared(pods: DataFrame, workloads: DataFrame, keep: bool = False, as_of: bool = True) -> Pods:
    """keep: identities and intervals are stored, as several lookups read them. as_of: see resolve()."""
    known, held = pod_identities(dims.latest(pods, "uid"), workloads), history.address_history(pods) if as_of else history.address_state(pods)
    if keep:
        known, held = stored(known, "pods"), stored(held, "addresses")
    yes = fits(pods)
    return Pods(known, held, yes, yes and few_generations(pods) if as_of else fits(held))


def by_address(sessions: DataFrame, ip: str, pods: Pods, prefix: str, few: bool) -> DataFrame:
    """sessions with the pod that had the address when the flow started (null: none): prefix + ident, created_at, deleted_at, host_network, early.

    A pod that came later answers too, as early, if it was there when the flow ended (where the sessions have an end_ns).
    """
    names = ("ident", "created_at", "deleted_at", "host_network", "early")
    held = small(pods.held, few).join(small(pods.known.drop("ip", "version"), few and pods.fits), "uid")
    held = held.select(F.col("ip").alias(ip), "since_ns", "until_ns", *[F.col(c).alias(f"{prefix}{c}") for c in names])
    if few:
        h = F.broadcast(held.withColumnRenamed(ip, "__ip"))
        j = sessions.join(h, (sessions[ip] == h["__ip"]) & history.covers(sessions["start_ns"], h["since_ns"], h["until_ns"]), "left")
        j = j.select(*[sessions[c] for c in sessions.columns], "until_ns", *[f"{prefix}{c}" for c in names])
    else:
        j = history.as_of(sessions, held, ip, "start_ns", BUCKET_NS, "__held")
        j = j.select(*sessions.columns, "__held.until_ns", *[f"__held.{prefix}{c}" for c in names])
    there = ~F.col(f"{prefix}early") | (F.col("until_ns") <= F.col("end_ns")) if "end_ns" in sessions.columns else F.lit(True)
    return j.withColumns({f"{prefix}{c}": F.when(there, F.col(f"{prefix}{c}")) for c in names}).drop("until_ns")


def confidence(found: Column, start_ns: Column, created: Column, deleted: Column, early: Column | None = None) -> Column:
    """high; low where the flow began before the pod (had the address), or within five minutes of the pod's deletion."""
    early = F.coalesce(start_ns < created, F.lit(False)) | (F.coalesce(early, F.lit(False)) if early is not None else F.lit(False))
    ending = F.coalesce(F.abs(start_ns - deleted) < RESTART_NS, F.lit(False))
    return F.when(found, F.when(early | ending, "low").otherwise("high"))


def resolve_sources(sessions: DataFrame, pods: DataFrame | Pods, workloads: DataFrame, cgroups: DataFrame, host_netns: int = 0) -> DataFrame:
    """Adds src (struct of FIELDS), src_confidence, src_method, src_external: cgroup, pod address, external, unknown."""
    own = pods if isinstance(pods, Pods) else prepared(pods, workloads)
    live = own.known.where("deleted_at IS NULL")
    by_cgroup = dims.cgroup_pods(cgroups).withColumnRenamed("container_id", "cg_container")
    one = by_cgroup.join(live.withColumnRenamed("uid", "pod_uid"), "pod_uid").select("cgroup_id", "cg_container", *[F.col(c).alias(f"c_{c}") for c in ("ident", "created_at", "deleted_at", "host_network", "containers", "container_name")])
    yes = own.fits and fits(cgroups)
    j = by_address(sessions.join(small(one, yes), "cgroup_id", "left"), "src_ip", own, "i_", own.few)
    by_c, by_i = F.col("c_ident").isNotNull() & (F.col("cgroup_id") != 0), F.col("i_ident").isNotNull()
    name = first_non_empty(dims.container_name(F.col("c_containers"), F.col("c_container_name"), F.col("cg_container")), F.col("c_container_name"))
    cident = F.col("c_ident").withField("container_name", name).withField("container_id", first_non_empty(F.col("cg_container"), F.col("c_ident.container_id")))
    external = ~by_c & ~by_i & net.is_external(F.col("src_ip"))
    sure = F.coalesce(confidence(by_c, F.col("start_ns"), F.col("c_created_at"), F.col("c_deleted_at")), confidence(by_i, F.col("start_ns"), F.col("i_created_at"), F.col("i_deleted_at"), F.col("i_early")))
    if host_netns:  # an address of the node's own network may be any of its pods'
        sure = F.when(~by_c & by_i & (F.col("netns_ino") == host_netns), "medium").otherwise(sure)
    out = j.withColumns({
        "src": F.when(by_c, cident).when(by_i, F.col("i_ident")).otherwise(_empty()),
        "src_confidence": F.coalesce(sure, F.when(external, "low").otherwise("unknown")),
        "src_method": F.when(by_c, "cgroup_id").when(by_i, "pod_ip").when(external, "external").otherwise("unknown"),
        "src_external": external,
        "src_cgroup_id": F.col("cgroup_id"),
    })
    return out.select(*sessions.columns, "src", "src_confidence", "src_method", "src_external", "src_cgroup_id")


def resolve_destinations(sessions: DataFrame, pods: DataFrame | Pods, workloads: DataFrame, services: DataFrame, slices: DataFrame) -> DataFrame:
    """Adds dst, dst_confidence, dst_method, dst_external, dst_service (struct): pod, service, endpoint, external, unknown.

    A pod's flow also gets the service whose endpoint it is.
    """
    ports = dims.service_ports(services)
    alias = dims.first_alias(dims.endpoint_aliases(slices, ports))
    own = pods if isinstance(pods, Pods) else prepared(pods, workloads)
    service = lambda p: F.struct(F.col("name").alias("name"), F.col("uid").alias("uid"), "namespace", "port_name", "app_protocol").alias(p)
    direct = ports.withColumn("s", service("s")).groupBy(F.col("cluster_ip").alias("dst_ip"), F.col("port").alias("dst_port")).agg(F.min_by("s", "uid").alias("s_service"))
    backed = alias.withColumnRenamed("service_name", "name").withColumnRenamed("service_uid", "uid").withColumn("e", service("e"))
    live = own.known.where("deleted_at IS NULL").select(F.col("uid").alias("target_pod_uid"), F.col("ident").alias("e_ident"), F.col("created_at").alias("e_created"), F.col("deleted_at").alias("e_deleted"))
    backed = backed.select(F.col("backend_ip").alias("dst_ip"), F.col("backend_port").alias("dst_port"), "target_pod_uid", F.col("e").alias("e_service"), "alias_seq", "slice_uid").join(live, "target_pod_uid", "left")
    backed = backed.groupBy("dst_ip", "dst_port").agg(F.min_by(F.struct("e_service", "e_ident", "e_created", "e_deleted"), F.struct("alias_seq", "slice_uid")).alias("b")).select("dst_ip", "dst_port", "b.*")
    yes = own.fits and fits(ports, slices.select(F.explode("endpoints")))
    j = by_address(sessions, "dst_ip", own, "p_", own.few).join(small(direct, yes), ["dst_ip", "dst_port"], "left").join(small(backed, yes), ["dst_ip", "dst_port"], "left")
    p, s, e = F.col("p_ident").isNotNull(), F.col("s_service").isNotNull(), F.col("e_service").isNotNull()
    external = ~p & ~s & ~e & net.is_external(F.col("dst_ip"))
    none = F.struct(*[F.lit("").alias(c) for c in ("name", "uid", "namespace", "port_name", "app_protocol")])
    out = j.withColumns({
        "dst": F.when(p, F.col("p_ident")).when(s, _empty().withField("namespace", F.col("s_service.namespace"))).when(e, F.coalesce("e_ident", _empty().withField("namespace", F.col("e_service.namespace")))).otherwise(_empty()),
        "dst_service": F.when(p, F.coalesce("e_service", none)).when(s, F.col("s_service")).when(e, F.col("e_service")).otherwise(none),
        "dst_confidence": F.coalesce(confidence(p, F.col("start_ns"), F.col("p_created_at"), F.col("p_deleted_at"), F.col("p_early")), F.when(s, "medium"), confidence(e & F.col("e_ident").isNotNull(), F.col("start_ns"), F.col("e_created"), F.col("e_deleted")), F.when(e, "medium").when(external, "low").otherwise("unknown")),
        "dst_method": F.when(p & e, "endpoint_slice").when(p, "pod_ip").when(s, "service_cluster_ip").when(e, "endpoint_slice").when(external, "external").otherwise("unknown"),
        "dst_external": external,
    })
    return out.select(*sessions.columns, "dst", "dst_confidence", "dst_method", "dst_external", "dst_service")


def mapping_method(src: Column, dst: Column) -> Column:
    return F.when(src == "cgroup_id", "cgroup_id").when(dst != "unknown", dst).otherwise(src)


def resolve(sessions: DataFrame, tables: dict[str, DataFrame], host_netns: int = 0, as_of: bool = True) -> DataFrame:
    """Both sides, mapping_method and pod_restart_window. tables: pods, workloads, cgroups, services, endpoint_slices.

    as_of: pods is a log, and an address is of the pod that had it when the flow started. Else it is a state: an address is of the one
    pod that took it over last, and after that one's tombstone of nobody.
    """
    pods = prepared(tables["pods"], tables["workloads"], keep=True, as_of=as_of)
    one = resolve_sources(sessions, pods, tables["workloads"], tables["cgroups"], host_netns)
    two = resolve_destinations(one, pods, tables["workloads"], tables["services"], tables["endpoint_slices"])
    restart = (F.col("src_confidence") == "low") | (F.col("dst_confidence") == "low")
    return two.withColumns({"mapping_method": mapping_method(F.col("src_method"), F.col("dst_method")), "pod_restart_window": restart})
