"""Flow events and dimension tables derived from the star-schema tables that tests and benches run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import image_digest
from .flow_events import normalise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


DESTINATIONS = [("10.244.1.20", 8080), ("10.96.0.10", 443), ("93.184.216.34", 443), ("10.244.3.10", 5432)]


def raw_flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup opens, error closes, the rest are counters; values add up per user. Of twelve users one is outside, one talks to itself, one has an IPv6 address."""
    e = read(spark, sf_dir, "events").withColumn("us", micros("ts"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda k: F.element_at(F.array(*[F.lit(d[k]) for d in DESTINATIONS]), (F.col("user_id") % 4 + 1).cast("int"))
    sent = F.sum(F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")).over(upto)
    gap = F.col("us") - F.lag("us").over(order)
    size = F.get_json_object("props", "$.k").cast("long") * 10
    user = F.col("user_id")
    inside = F.concat(F.lit("10.244."), user % 3, F.lit("."), user % 250)
    source = F.when(user % 12 == 11, F.concat(F.lit("93.184.216."), user % 250)).when(user % 12 == 10, pick(0)).when(user % 12 == 9, F.concat(F.lit("2001:db8::"), user % 9999)).otherwise(inside)
    return e.select(
        F.col("event_id").alias("seq"), (F.col("us") * 1000).alias("timestamp_ns"),
        F.when(F.col("event_type") == "signup", "CONNECT").when(F.col("event_type") == "error", "CLOSE").otherwise("STATS").alias("event_type"),
        source.alias("src_ip"), (F.col("user_id") + 40000).cast("int").alias("src_port"),
        pick(0).alias("dst_ip"), pick(1).alias("dst_port"), sent.alias("bytes_sent"), (3 * sent).alias("bytes_recv"), F.count("*").over(upto).alias("packets_sent"), F.count("*").over(upto).alias("packets_recv"),
        F.array_compact(F.array(size)).alias("packet_sizes"), F.array_compact(F.array(gap)).alias("iat_us"), F.col("user_id").alias("cgroup_id"),
    )


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(raw_flow_events(spark, sf_dir), decode_tls=False)


FLOW_SQL = """
e AS (SELECT *, epoch_us(ts) AS us FROM events),
f AS (
    SELECT event_id AS seq, us * 1000 AS timestamp_ns, user_id,
        CASE event_type WHEN 'signup' THEN 'CONNECT' WHEN 'error' THEN 'CLOSE' ELSE 'STATS' END AS event_type,
        CASE user_id % 12 WHEN 11 THEN '93.184.216.' || (user_id % 250) WHEN 10 THEN '93.184.216.34' WHEN 9 THEN '2001:db8::' || (user_id % 9999) ELSE '10.244.' || (user_id % 3) || '.' || (user_id % 250) END AS src_ip, CAST(user_id + 40000 AS INTEGER) AS src_port,
        (['10.244.1.20', '10.96.0.10', '93.184.216.34', '10.244.3.10'])[user_id % 4 + 1] AS dst_ip, ([8080, 443, 443, 5432])[user_id % 4 + 1] AS dst_port, 'tcp' AS protocol,
        CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) OVER w AS BIGINT) AS bytes_sent, CAST(3 * sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) OVER w AS BIGINT) AS bytes_recv,
        count(*) OVER w AS packets_sent, count(*) OVER w AS packets_recv, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS size, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iat
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
n AS (
    SELECT *, coalesce(sum(CASE WHEN event_type = 'CLOSE' THEN 1 ELSE 0 END) OVER (PARTITION BY src_port ORDER BY timestamp_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session_no,
        row_number() OVER (PARTITION BY src_port ORDER BY timestamp_ns, seq) AS k
    FROM f)
"""


def pod_uid(key: Column) -> Column:
    """Every fourth has the uid that its cgroup path names."""
    digits = F.sha2(key.cast("string"), 256)
    return F.when(key % 4 == 0, F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])).otherwise(F.concat(F.lit("pod-"), key))


POD_UID_SQL = "CASE WHEN {k} % 4 = 0 THEN regexp_replace(substr(sha256(CAST({k} AS VARCHAR)), 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') ELSE 'pod-' || {k} END"
JANUARY = 1_704_067_200


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod per customer; some addresses are shared, so later versions take them over. All pods of every 7th address are deleted: long ago, or while events happen."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = lambda p, x: F.concat(F.lit(p), x)
    owners = F.when(key % 2 == 0, F.array(F.struct(F.lit("ReplicaSet").alias("kind"), name("rs-", F.col("c_nationkey")).alias("name"), name("rs-", F.col("c_nationkey")).alias("uid")))).otherwise(F.array().cast("array<struct<kind:string,name:string,uid:string>>"))
    return c.select(
        name("ns-", F.col("c_nationkey") % 5).alias("namespace"), F.col("c_name").alias("name"), pod_uid(key).alias("uid"),
        F.concat(F.lit("10.244."), key % 3, F.lit("."), key % 250).alias("ip"), name("node-", F.col("c_nationkey")).alias("node_name"), F.lit("main").alias("container_name"),
        F.sha2(key.cast("string"), 256).alias("container_id"), F.create_map(F.concat(F.lit("containerd://"), F.sha2(key.cast("string"), 256)), F.lit("main"), F.concat(F.lit("docker://"), F.sha2(F.concat(F.lit("c"), key), 256)), F.lit("sidecar")).alias("containers"),
        image_digest(F.concat(F.lit("registry/app@sha256:"), key)).alias("image_digest"), F.lower("c_mktsegment").alias("service_account"), owners.alias("owners"),
        F.create_map(F.lit("app"), F.col("c_mktsegment")).alias("labels"), F.lit(0).cast("long").alias("created_at"),
        F.when(key % 250 % 7 == 0, F.when(key % 2 == 0, key).otherwise(JANUARY + key * 7919 % 2_592_000) * 1_000_000_000).alias("deleted_at"), F.lit(False).alias("host_network"), key.alias("version"),
    )


def address_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod per order on one of 499 addresses, from its date on; three of four are deleted after some days, so addresses go through many hands."""
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    born = micros("o_orderdate") * 1000
    days = F.lit(86_400_000_000_000)
    c = pods(spark, sf_dir).limit(0)
    own = o.select(F.lit("ns").alias("namespace"), F.concat(F.lit("run-"), key).alias("name"), F.concat(F.lit("o-"), key).alias("uid"), F.concat(F.lit("10.9.0."), F.col("o_custkey") % 499).alias("ip"), born.alias("created_at"), F.when(key % 4 != 0, born + (1 + key % 60) * days).alias("deleted_at"), key.alias("version"))
    return c.unionByName(own, allowMissingColumns=True)


def dated_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow of three days per line item, from one of the 499 addresses."""
    i = read(spark, sf_dir, "lineitem")
    start = micros("l_shipdate") * 1000
    return i.select("l_orderkey", "l_linenumber", F.concat(F.lit("10.9.0."), (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 499).alias("src_ip"), start.alias("start_ns"), (start + 3 * 86_400_000_000_000).alias("end_ns"), F.lit(0).cast("long").alias("cgroup_id"), F.lit(0).cast("long").alias("netns_ino"))


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ReplicaSet per nation, owned by the Deployment of its region; the last region's Deployment is unknown."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").where("r_regionkey < 4")
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    rs = n.select(F.lit("ReplicaSet").alias("kind"), F.lit("ns").alias("namespace"), name("rs-", "n_nationkey").alias("name"), name("rs-", "n_nationkey").alias("uid"), F.lit("Deployment").alias("owner_kind"), name("dep-", "n_regionkey").alias("owner_uid"), F.lit("1").alias("revision"), name("h", "n_nationkey").alias("pod_template_hash"), F.lit("").alias("image"))
    dep = r.select(F.lit("Deployment").alias("kind"), F.lit("ns").alias("namespace"), F.lower("r_name").alias("name"), name("dep-", "r_regionkey").alias("uid"), F.lit("").alias("owner_kind"), F.lit("").alias("owner_uid"), F.lit("2").alias("revision"), F.lit("").alias("pod_template_hash"), F.lit("").alias("image"))
    return rs.unionByName(dep)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    port = F.struct(F.lit(443).alias("port"), F.when(key % 2 == 0, 8443).otherwise(0).alias("target_port"), F.when(key % 3 == 0, "web").otherwise("").alias("target_name"), F.lit("https").alias("name"), F.lit(None).cast("string").alias("app_protocol"), F.lit("TCP").alias("protocol"))
    return s.select(F.concat(F.lit("ns-"), F.col("s_nationkey") % 5).alias("namespace"), F.col("s_name").alias("name"), F.concat(F.lit("svc-"), key).alias("uid"), F.array(F.concat(F.lit("10.96."), key.cast("long") % 2, F.lit("."), key % 250), F.lit("None")).alias("cluster_ips"), F.array(port).alias("ports"), key.alias("version"))


def endpoint_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    port = F.struct(F.when(key % 5 == 0, 443).otherwise(8443).alias("port"), F.when(key % 3 == 0, "web").otherwise("other").alias("name"), F.lit("TCP").alias("protocol"))
    endpoint = F.struct(F.array(F.concat(F.lit("10.244."), key % 3, F.lit("."), key % 250)).alias("addresses"), pod_uid(key).alias("target_pod_uid"))
    return s.select(F.concat(F.lit("ns-"), F.col("s_nationkey") % 5).alias("namespace"), F.concat(F.lit("slice-"), key).alias("uid"), F.concat(F.lit("slice-"), key).alias("name"), F.col("s_name").alias("service_name"), F.array(endpoint).alias("endpoints"), F.array(port).alias("ports"), key.alias("version"))


def cgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in three forms; the uid in them is 32 hex digits of the customer key's digest."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    uid, container = F.substring(F.sha2(key.cast("string"), 256), 1, 32), F.sha2(F.concat(F.lit("c"), key), 256)
    tail = F.when(key % 3 == 0, F.concat(F.lit("cri-containerd-"), container, F.lit(".scope"))).when(key % 3 == 1, F.concat(F.lit("docker-"), container, F.lit(".scope"))).otherwise(F.lit("init.scope"))
    return c.select(key.alias("cgroup_id"), F.concat(F.lit("/kubepods.slice/kubepods-pod"), uid, F.lit(".slice/"), tail).alias("path"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet per line item: flow l_orderkey, ordered by ship date and line number."""
    i = read(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", (micros("l_shipdate") * 1000).alias("ts_ns"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity") * 40).cast("long").alias("length"), (F.col("l_returnflag") != "R").alias("outgoing"))
