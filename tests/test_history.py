"""Addresses as of a time: generations, tombstones, moves; the sorted merge against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlens import schema as S
from sessionlens.operators import dims, history, identity

G = 1_000_000_000
TTL = dims.TOMBSTONE_NS // G


def pod(uid, ip, created, deleted=None, version=1, changed=None):
    g = lambda x: None if x is None else x * G
    return ("ns", f"n-{uid}", uid, ip, "n1", "main", "c", {}, "", "sa", [], {}, g(created), g(deleted), False, version, g(changed))


def table(spark, rows):
    return spark.createDataFrame(rows, S.PODS + ", changed_at long")


def answer(rows, ip, t):
    """Brute force: (uid, early) of an address at a time in seconds."""
    last = {}
    for r in rows:
        last[r[2]] = max(last.get(r[2], (-1, None)), (r[15], r[13]), key=lambda x: x[0])
    claims = []
    for uid in last:
        own = sorted((r for r in rows if r[2] == uid), key=lambda r: r[15])
        starts = [r[16] if r[16] is not None else r[12] or 0 for r in own]
        for r, since, after in zip(own, starts, [*starts[1:], None], strict=True):
            end = last[uid][1]
            gone = min(x for x in (after, end, history.NEVER) if x is not None)
            if r[3] and (gone > since or gone == end):
                claims.append((since, r[15], uid, gone, gone == end, r[3]))
    mine, at = [c for c in claims if c[5] == ip], t * G

    def held(at):
        live = [c for c in mine if c[0] <= at < c[3]]
        if live:
            return min(live, key=lambda c: (-c[0], -c[1], c[2]))[2]
        dead = [c for c in mine if c[4] and c[0] <= at and c[3] <= at < c[3] + dims.TOMBSTONE_NS]
        return min(dead, key=lambda c: (-c[1], c[2]))[2] if dead else None

    if held(at):
        return held(at), False
    later = sorted({x for c in mine for x in (c[0], c[3]) if x > at and held(x)})
    return (held(later[0]), True) if later else None


GENERATIONS = [
    pod("a", "10.0.0.1", 100, 1000), pod("b", "10.0.0.1", 2000, 5000, version=2), pod("c", "10.0.0.1", 5100, version=3),  # three, one after another
    pod("x", "10.0.0.2", 0, version=4), pod("y", "10.0.0.2", 500, 900, version=5),  # y takes the address, x has it again
    pod("m", "10.0.0.3", 100, version=1), pod("m", "10.0.0.4", 100, version=2, changed=700), pod("m", "10.0.0.4", 100, 2000, version=3, changed=2000),  # moves, then goes
    pod("e", "", 5), pod("z", "10.0.0.5", 50, 40),
]


def test_intervals_of_generations(spark):
    got = {}
    for r in history.address_history(table(spark, GENERATIONS)).collect():
        got.setdefault(r.ip, []).append((r.since_ns if r.since_ns == history.ALWAYS else r.since_ns // G, r.until_ns if r.until_ns == history.NEVER else r.until_ns // G, r.uid, r.early))
    assert sorted(got["10.0.0.1"]) == [(history.ALWAYS, 100, "a", True), (100, 1000 + TTL, "a", False), (1000 + TTL, 2000, "b", True), (2000, 5100, "b", False), (5100, history.NEVER, "c", False)]
    assert [x[2:] for x in sorted(got["10.0.0.2"])] == [("x", True), ("x", False), ("y", False), ("x", False)]
    assert sorted(got["10.0.0.3"])[-1][:3] == (100, 700, "m") and sorted(got["10.0.0.4"])[-1][:3] == (700, 2000 + TTL, "m")


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(60):
        created = rnd.randrange(0, 5000, 50)
        deleted = created + rnd.randrange(0, 3000, 50) if rnd.random() < 0.6 else None
        for v in range(rnd.randint(1, 3)):
            rows.append(pod(f"u{k}", rnd.choice(["i1", "i2", "i3", ""]), created, deleted if v or rnd.random() < 0.5 else None, version=10 * v + k % 7, changed=rnd.choice([None, created + 100 * v])))
    rnd.shuffle(rows)
    flows = [(k, rnd.choice(["i1", "i2", "i3", "i4", None]), rnd.choice([None, rnd.randrange(-10, 9000)])) for k in range(400)]
    df = spark.createDataFrame([(k, ip, None if t is None else t * G) for k, ip, t in flows], "k int, ip string, t long")
    segments = history.address_history(table(spark, rows))
    got = {r.k: (r.answer.uid, r.answer.early) if r.answer else None for r in history.as_of(df, segments, "ip", "t", 700 * G).collect()}
    assert got == {k: answer(rows, ip, t) if ip and t is not None else None for k, ip, t in flows}


def resolved(spark, pods, flows, columns="k int, src_ip string, dst_ip string, dst_port int, protocol string, cgroup_id long, netns_ino long, start_ns long, end_ns long"):
    empty = {"workloads": S.WORKLOADS, "services": S.SERVICES, "endpoint_slices": S.ENDPOINT_SLICES, "cgroups": S.CGROUPS}
    tables = {"pods": pods} | {k: spark.createDataFrame([], v) for k, v in empty.items()}
    return {r.k: r for r in identity.resolve(spark.createDataFrame(flows, columns), tables).collect()}


@pytest.mark.parametrize("generations", [64, 0])
def test_flows_belong_to_the_pod_of_their_time(spark, monkeypatch, generations):
    """By a range join and by the sorted merge alike."""
    monkeypatch.setattr(identity.few_generations, "__defaults__", (generations,))
    times = {1: (500, 600), 2: (1000, 1001), 3: (1299, 1300), 4: (1300, 1400), 5: (1400, 2500), 6: (4000, 4001), 7: (5099, 6000), 8: (5200, 5300), 9: (9000, 9001), 10: (10, 50), 11: (10, 150)}
    flows = [(k, "10.0.0.1", "10.0.0.1", 1, "tcp", 0, 0, a * G, b * G) for k, (a, b) in times.items()]
    r = resolved(spark, table(spark, GENERATIONS), flows)
    want = {1: ("n-a", "high"), 2: ("n-a", "low"), 3: ("n-a", "low"), 4: ("", "unknown"), 5: ("n-b", "low"), 6: ("n-b", "high"), 7: ("n-b", "low"), 8: ("n-c", "high"), 9: ("n-c", "high"), 10: ("", "unknown"), 11: ("n-a", "low")}
    for side in ("src", "dst"):
        assert {k: (x[side].pod_name, x[f"{side}_confidence"]) for k, x in r.items()} == want


def test_a_hot_address_is_spread_over_buckets(spark):
    """One address with all rows: no task of the merge sees them all."""
    segments = history.address_history(table(spark, GENERATIONS))
    rows = spark.range(4000).select(F.lit("10.0.0.1").alias("ip"), (F.col("id") * G).alias("t"))
    out = history.as_of(rows, segments, "ip", "t", 100 * G)
    assert out.groupBy("answer.uid").count().orderBy("uid").collect() == [("a", 1300), ("b", 2700)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("few", [True, False])
def test_a_state_gives_an_address_to_its_last_pod_only(spark, monkeypatch, few):
    """By a broadcast and by the sorted merge alike; a log has the address go back to the pod that outlives its successor."""
    if not few:
        monkeypatch.setattr(identity, "fits", lambda *t, **k: False)
    pods = table(spark, [pod("x", "10.0.0.2", 0, version=1, deleted=9000), pod("y", "10.0.0.2", 0, 900, version=2), pod("l", "10.0.0.3", 0, version=1), pod("d", "10.0.0.3", 0, 900, version=2)])
    rows = [(k, ip, at * G, at * G) for k, (ip, at) in enumerate([("10.0.0.2", 100), ("10.0.0.2", 1199), ("10.0.0.2", 1200), ("10.0.0.2", 5000), ("10.0.0.3", 100), ("10.0.0.3", 5000), ("10.0.0.4", 1)])]
    flows = spark.createDataFrame([(*r, 0, 0) for r in rows], "k int, src_ip string, start_ns long, end_ns long, cgroup_id long, netns_ino long")
    loads, groups = spark.createDataFrame([], S.WORKLOADS), spark.createDataFrame([], S.CGROUPS)
    got = lambda as_of: [(r.src.pod_name, r.src_confidence) for r in identity.resolve_sources(flows, identity.prepared(pods, loads, as_of=as_of), loads, groups).orderBy("k").collect()]
    last = [("n-l", "high"), ("n-l", "high"), ("", "unknown")]
    assert got(False) == [("n-y", "high"), ("n-y", "low"), ("", "unknown"), ("", "unknown"), *last]
    assert got(True) == [("n-y", "high"), ("n-x", "high"), ("n-x", "high"), ("n-x", "high"), ("n-d", "high"), *last[1:]]
