"""Per-packet input: flow statistics, inter-arrival times, first hellos, gated counters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.tls import is_candidate
from .gates import drifting_gates

EMIT_NS = 5 * 1_000_000_000


def both_ways_key(packets: DataFrame, ingress: Column) -> DataFrame:
    """Source and destination swapped on ingress, so that both directions of a connection share a key."""
    swap = lambda a, b: F.when(ingress, F.col(b)).otherwise(F.col(a))
    return packets.withColumns({"src_ip": swap("src_ip", "dst_ip"), "dst_ip": swap("dst_ip", "src_ip"), "src_port": swap("src_port", "dst_port"), "dst_port": swap("dst_port", "src_port")})


def with_iat(packets: DataFrame, key: list[str], outgoing: Column, at: str = "ts_ns", seq: str = "seq") -> DataFrame:
    """Adds iat_us: microseconds since the flow's packet before in the same direction; null for the first and for equal times."""
    order = Window.partitionBy(*key, "__out").orderBy(at, seq)
    gap = F.col(at) - F.lag(at).over(order)
    return packets.withColumn("__out", outgoing).withColumn("iat_us", F.when(gap > 0, F.floor(gap / 1000).cast("long"))).drop("__out")


def flow_statistics(packets: DataFrame, key: list[str], outgoing: Column, at: str = "ts_ns", seq: str = "seq", length: str = "length") -> DataFrame:
    """Bytes and packets by direction, size bounds (0 is no size), counts per size and inter-arrival bucket, gaps and bursts.

    Partial sums leave each task; only the inter-arrival times need the packets of a flow in order.
    """
    rows = with_iat(packets.withColumn("__way", outgoing), key, F.col("__way"), at, seq)
    out, size, iat = F.col("__way"), F.col(length), F.col("iat_us")
    real = F.nullif(size, F.lit(0))
    size_bucket, iat_bucket = stats.packet_bucket(size), stats.iat_bucket(iat)
    return rows.groupBy(*key).agg(
        F.sum(F.when(out, size).otherwise(0)).alias("bytes_out"), F.sum(F.when(~out, size).otherwise(0)).alias("bytes_in"),
        F.count_if(out).alias("packets_out"), F.count_if(~out).alias("packets_in"),
        F.min(real).alias("pkt_size_min"), F.max(real).alias("pkt_size_max"),
        F.array(*[F.count_if(size_bucket == k) for k in range(7)]).alias("size_counts"),
        F.array(*[F.count_if(iat_bucket == k) for k in range(6)]).alias("iat_counts"),
        F.count_if(iat > 1_000_000).alias("idle_gap_count"), F.count_if((iat > 0) & (iat < 10_000)).alias("burst_count"),
    )


def rate_limited_stats(packets: DataFrame, key: list[str], outgoing: Column, interval_ns: int = EMIT_NS, at: str = "ts_ns", seq: str = "seq", length: str = "length") -> DataFrame:
    """STATS events of each flow, one every interval_ns at most: key, timestamp_ns, event_type and the counters of the flow so far.

    A flow's first packet starts its gate and emits nothing; a later one emits where the last emission (or the start) is the
    interval or more ago. Packets without bytes neither count nor emit.
    """
    order = Window.partitionBy(*key).orderBy(at, seq)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = packets.withColumn("__out", outgoing).where(F.col(length) > 0).withColumn("__place", F.row_number().over(order).cast("long"))
    emitted = drifting_gates(rows, key, "__place", at, F.col("__place") == 1, F.lit(True), interval_ns)
    out, size = F.col("__out"), F.col(length)
    sums = {"bytes_sent": F.sum(F.when(out, size).otherwise(0)), "bytes_recv": F.sum(F.when(~out, size).otherwise(0)), "packets_sent": F.count_if(out), "packets_recv": F.count_if(~out)}
    counted = rows.select(*key, "__place", F.col(at).alias("timestamp_ns"), *[v.over(upto).alias(c) for c, v in sums.items()])
    return counted.join(emitted, [*key, "__place"]).select(*key, "timestamp_ns", F.lit("STATS").alias("event_type"), *sums)


def first_hellos(packets: DataFrame, key: list[str], payload: str = "payload", at: str = "ts_ns", seq: str = "seq", most: int = 1024, long_flows: bool = False) -> DataFrame:
    """The first client and the first server hello of each flow, at most so many bytes of it: key, kind (1 client, 2 server), payload.

    long_flows: many packets of few flows. The first times of all flows are gathered before and broadcast, so that only packets of
    those times are sorted, with their payloads; the packets are read twice.
    """
    kind = F.when(is_candidate(F.col(payload), 1), 1).when(is_candidate(F.col(payload), 2), 2)
    order = Window.partitionBy(*key, "kind").orderBy(at, seq)
    if long_flows:  # kinds are judged last: a filter by kind would go below all this and cut each payload out many times
        rows = at_first_times(packets, packets.withColumn("kind", kind), key, at).withColumn("kind", kind)
        place = F.when(F.col("kind").isNotNull(), F.row_number().over(order))
    else:
        rows, place = packets.withColumn("kind", kind).where("kind IS NOT NULL"), F.row_number().over(order)
    return rows.withColumn(payload, F.substring(payload, 1, most)).withColumn("__r", place).where("__r = 1").drop("__r")


def at_first_times(packets: DataFrame, kinds: DataFrame, key: list[str], at: str) -> DataFrame:
    """The packets at the time of their flow's first hello of either kind. A missing time is the first, as in an ascending order."""
    time = F.col(at)
    of = lambda k: F.when(F.count_if((F.col("kind") == k) & time.isNull()) == 0, F.min(F.when(F.col("kind") == k, time)))
    found = [F.struct((F.count_if(F.col("kind") == k) > 0).alias("any"), of(k).alias("at")) for k in (1, 2)]
    firsts = kinds.groupBy(*key).agg(F.array(*found).alias("f")).select(*[F.col(c).alias(f"__{c}") for c in key], F.explode("f").alias("f"))
    firsts = firsts.where("f.any").select(*[f"__{c}" for c in key], F.col("f.at").alias(f"__{at}"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*key, at)]
    return packets.join(F.broadcast(firsts), reduce(and_, same), "left_semi")


def state_events(changes: DataFrame) -> DataFrame:
    """Connection state changes as events: ESTABLISHED opens with one SYN and zero counters, CLOSE adds a FIN; others go."""
    kind = F.when(F.col("state") == "ESTABLISHED", "CONNECT").when(F.col("state") == "CLOSE", "CLOSE")
    rows = changes.withColumn("event_type", kind).where("event_type IS NOT NULL")
    opens = F.col("event_type") == "CONNECT"
    counters = {c: F.when(opens, 0).otherwise(F.coalesce(F.col(c), F.lit(0))) for c in ("bytes_sent", "bytes_recv", "packets_sent", "packets_recv") if c in changes.columns}
    return rows.withColumns(counters | {"syn_count": F.when(opens, 1).otherwise(0), "fin_count": F.when(opens, 0).otherwise(1)})


def paired_calls(calls: DataFrame, thread: str = "pid_tgid", at: str = "ts_ns") -> DataFrame:
    """Returns of receive calls with what the entry before them in the same thread stashed: entry (struct) per return; unpaired returns go."""
    order = Window.partitionBy(thread).orderBy(at)
    before = F.lag(F.struct("phase", "socket")).over(order)
    return calls.withColumn("entry", before).where("phase = 'return' AND entry.phase = 'entry'").withColumn("socket", F.col("entry.socket")).drop("entry")


def accounted(calls: DataFrame, key: list[str]) -> DataFrame:
    """Sends count what was asked for, receives what came back (if anything): bytes and messages by direction."""
    sent, got = F.col("call") == "send", (F.col("call") == "recv") & (F.col("returned") > 0)
    return calls.groupBy(*key).agg(F.sum(F.when(sent, F.col("requested")).otherwise(0)).alias("bytes_sent"), F.count_if(sent).alias("packets_sent"), F.sum(F.when(got, F.col("returned")).otherwise(0)).alias("bytes_recv"), F.count_if(got).alias("packets_recv"))
