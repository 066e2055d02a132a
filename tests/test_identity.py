"""Lookups by priority on hand-made dimension tables."""

import pytest

from sessionlens import schema as S
from sessionlens.operators import dims, identity
from sessionlens.plans.ledger import agent_id, hook_source, sampling_rate

G = 1_000_000_000
UID = "0123abcd-0123-0123-0123-0123456789ab"


def pod(name, ip, uid=None, version=1, owners=(), deleted=None, containers=None, created=0, host=False):
    return ("ns", name, uid or f"u-{name}", ip, "n1", "main", "containerd://c1", containers or {"containerd://c1": "main", "containerd://c2": "sidecar"}, "", "sa", [tuple(o) for o in owners], {}, created, deleted, host, version)


@pytest.fixture(scope="module")
def tables(spark):
    pods = [
        pod("bare", "10.1.0.1"), pod("old", "10.1.0.2", version=1), pod("new", "10.1.0.2", version=2), pod("gone", "10.1.0.3", deleted=1000 * G),
        pod("web", "10.1.0.4", uid=UID, owners=[("Other", "x", "x"), ("ReplicaSet", "web-1", "rs1")]), pod("job", "10.1.0.5", owners=[("Job", "j", "j1")]), pod("lost", "10.1.0.6", owners=[("ReplicaSet", "lost-1", "rs9")]), pod("late", "10.1.0.7", created=5000 * G),
    ]
    loads = [("ReplicaSet", "ns", "web-1", "rs1", "Deployment", "d1", "3", "h1", ""), ("Deployment", "ns", "web", "d1", "", "", "4", "", ""), ("Job", "ns", "j", "j1", "CronJob", "cj", "", "", ""), ("CronJob", "ns", "nightly", "cj", "", "", "", "", "")]
    services = [("ns", "front", "s1", ["10.96.0.1", "None", ""], [(443, 8443, "", "https", None, "TCP")], 1), ("ns", "front2", "s2", ["10.96.0.2"], [(80, None, "web", "", "grpc", None)], 1)]
    slices = [("ns", "e1", "e1", "front", [(["10.1.0.4", "10.9.0.9"], UID)], [(8443, "x", "TCP"), (None, "y", "TCP")], 1), ("ns", "e2", "e2", "front2", [(["10.8.0.8"], None)], [(9000, "web", None)], 1)]
    groups = [(77, f"/kubepods.slice/kubepods-pod{UID.replace('-', '_')}.slice/cri-containerd-c2.scope"), (78, "/system.slice/ssh")]
    return {"pods": spark.createDataFrame(pods, S.PODS), "workloads": spark.createDataFrame(loads, S.WORKLOADS), "services": spark.createDataFrame(services, S.SERVICES), "endpoint_slices": spark.createDataFrame(slices, S.ENDPOINT_SLICES), "cgroups": spark.createDataFrame(groups, S.CGROUPS)}


def resolved(spark, tables, rows, **more):
    s = spark.createDataFrame(rows, "k int, src_ip string, dst_ip string, dst_port int, protocol string, cgroup_id long, netns_ino long, start_ns long")
    return {r.k: r for r in identity.resolve(s, tables, **more).collect()}


def test_sources(spark, tables):
    flow = lambda k, ip, cgroup=0, at=9000: (k, ip, "0.0.0.0", 1, "tcp", cgroup, 5, at * G)
    r = resolved(spark, tables, [flow(1, "10.1.0.1"), flow(2, "10.1.0.2"), flow(3, "10.1.0.1", 77), flow(4, "8.8.8.8"), flow(5, "10.200.0.1"), flow(6, "10.1.0.3", at=1100), flow(7, "10.1.0.7", at=1), flow(8, "10.1.0.1", 78)])
    assert (r[1].src.pod_name, r[1].src.workload_kind, r[1].src_confidence, r[1].src_method) == ("bare", "BarePod", "high", "pod_ip")
    assert r[2].src.pod_name == "new"
    assert (r[3].src.pod_uid, r[3].src.container_name, r[3].src.container_id, r[3].src_method, r[3].mapping_method) == (UID, "sidecar", "c2", "cgroup_id", "cgroup_id")
    assert (r[3].src.workload_kind, r[3].src.workload_name, r[3].src.replicaset, r[3].src.revision, r[3].src.pod_template_hash) == ("Deployment", "web", "web-1", "4", "h1")
    assert (r[4].src_confidence, r[4].src_method, r[4].src_external, r[4].pod_restart_window) == ("low", "external", True, True)
    assert (r[5].src_confidence, r[5].src_method, r[5].pod_restart_window) == ("unknown", "unknown", False)
    assert r[6].src.pod_name == "gone" and r[6].src_confidence == "low" and r[7].src_confidence == "low" and r[8].src_method == "pod_ip"
    assert resolved(spark, tables, [flow(1, "10.1.0.7", at=1)], host_netns=5)[1].src_confidence == "medium"


def test_destinations(spark, tables):
    flow = lambda k, ip, port: (k, "0.0.0.0", ip, port, "tcp", 0, 5, 9000 * G)
    r = resolved(spark, tables, [flow(1, "10.1.0.4", 8443), flow(2, "10.1.0.4", 1), flow(3, "10.96.0.1", 443), flow(4, "10.9.0.9", 8443), flow(5, "10.8.0.8", 9000), flow(6, "93.184.216.34", 443), flow(7, "10.96.0.1", 80)])
    assert (r[1].dst.pod_name, r[1].dst_service.name, r[1].dst_service.port_name, r[1].dst_method) == ("web", "front", "https", "endpoint_slice")
    assert (r[2].dst.pod_name, r[2].dst_service.name, r[2].dst_method) == ("web", "", "pod_ip")
    assert (r[3].dst_service.name, r[3].dst.namespace, r[3].dst_confidence, r[3].dst_method) == ("front", "ns", "medium", "service_cluster_ip")
    assert (r[4].dst.pod_uid, r[4].dst_confidence, r[4].dst_method) == (UID, "high", "endpoint_slice")
    assert (r[5].dst.pod_name, r[5].dst_service.name, r[5].dst_service.app_protocol, r[5].dst_confidence) == ("", "front2", "grpc", "medium")
    assert (r[6].dst_external, r[6].dst_confidence, r[7].dst_method) == (True, "low", "unknown")


def test_owners(spark, tables):
    got = {r.uid: (r.workload_kind, r.workload_name) for r in dims.workload_of(tables["pods"], tables["workloads"]).collect()}
    assert got["u-job"] == ("CronJob", "nightly") and got["u-lost"] == ("ReplicaSet", "lost-1") and got["u-bare"] == ("BarePod", "bare")


def test_tombstones_pass_away(spark, tables):
    known = lambda at: {r.ip for r in dims.pods_by_ip(tables["pods"], at_ns=at * G).collect()}
    assert "10.1.0.3" in known(1200) and "10.1.0.3" not in known(1400)


def test_flows_long_after_a_deletion_are_of_nobody(spark, tables):
    flow = lambda k, src, dst, at: (k, src, dst, 1, "tcp", 0, 5, at * G)
    r = resolved(spark, tables, [flow(1, "10.1.0.3", "10.1.0.3", 900), flow(2, "10.1.0.3", "10.1.0.3", 600), flow(3, "10.1.0.3", "10.1.0.3", 1299), flow(4, "10.1.0.3", "10.1.0.3", 1300), flow(5, "10.1.0.3", "10.1.0.3", 900_000)])
    for side in ("src", "dst"):
        assert [(r[k][f"{side}_confidence"], r[k][side].pod_name) for k in range(1, 6)] == [("low", "gone"), ("high", "gone"), ("low", "gone"), ("unknown", ""), ("unknown", "")]


def test_empty_tables_and_large_ones_join_alike(spark, tables, monkeypatch):
    flow = [(1, "10.1.0.1", "10.96.0.1", 443, "tcp", 0, 5, 9000 * G)]
    small = resolved(spark, tables, flow)[1]
    monkeypatch.setattr(identity, "fits", lambda *t, **k: False)
    assert resolved(spark, tables, flow)[1] == small


def test_scans_differ(spark):
    schema = "cgroup_id long, path string, note string"
    before = spark.createDataFrame([(1, "/a", None), (2, "/b", "x"), (3, "/c", None), (3, "/c", None)], schema)
    after = spark.createDataFrame([(1, "/a", None), (2, "/b", None), (4, "/d", "y")], schema)
    got = sorted((r.cgroup_id, r.change, r.path, r.note) for r in dims.scan_changes(before, after).collect())
    assert got == [(2, "changed", "/b", None), (3, "removed", "/c", None), (4, "added", "/d", "y")]
    assert dims.scan_changes(before.limit(0), after).where("change = 'added'").count() == 3 and dims.scan_changes(after, after).count() == 0


def test_constants():
    assert agent_id("", "n", "h") == "n/h" and agent_id("a", "n", "h") == "a" and agent_id("", "n", "n") == "n" and agent_id("", "", "h") == "h" and agent_id("", "n") == "n"
    assert hook_source("x") == "unknown" and hook_source("mock") == "mock" and hook_source("ebpf") == "tracepoint:sock:inet_sock_set_state"
    assert [sampling_rate({"sampling_rate": r} if r is not None else {}) for r in (None, "0", -1, 0.25)] == [1.0, 1.0, 1.0, 0.25]
