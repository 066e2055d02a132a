"""Who had an address when: validity intervals from a change log, and lookups as of a time without pairs of all rows.

A version of a pod claims its address from when it holds (changed_at where the log has it, else created_at) until the pod moves to
another address or is deleted; a deleted pod stays a tombstone for five minutes. Of the pods that claim an address at a time the
last to come answers (then the highest version, then the smallest uid); where none is alive the tombstone of the highest version.
So an address has one answer at any time, and a pod that outlives its successor answers again.

Defined results: versions without an address claim nothing; rows of equal uid and version count once; a log in any order gives the
same intervals. Before the first pod of an address and between pods the next one answers, marked early: whoever looks up decides
whether it was there when the flow ended.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dims import TOMBSTONE_NS, latest, one_by_ip

ALWAYS, NEVER = -(2**63), 2**63 - 1
SEGMENT = "ip string, since_ns long, until_ns long, uid string, early boolean"


def claims(pods: DataFrame) -> DataFrame:
    """ip, uid, version, since_ns, gone_ns (NEVER: still there), deleted (whether it goes by deletion)."""
    own = Window.partitionBy("uid")
    held = F.coalesce(*[F.col(c) for c in ("changed_at", "created_at") if c in pods.columns], F.lit(0)).cast("long")
    rows = pods.select("uid", "ip", "version", "deleted_at", held.alias("since_ns")).dropDuplicates(["uid", "version"])
    after = F.lead("since_ns").over(own.orderBy("version"))
    end = F.max_by("deleted_at", "version").over(own)
    rows = rows.withColumns({"next_ns": after, "end_ns": end}).where("ip <> ''")
    gone = F.least(F.coalesce("next_ns", F.lit(NEVER)), F.coalesce("end_ns", F.lit(NEVER)))
    rows = rows.withColumn("gone_ns", gone)
    return rows.where("gone_ns > since_ns OR gone_ns = end_ns").select("ip", "uid", "version", "since_ns", "gone_ns", (F.coalesce(F.col("gone_ns") == F.col("end_ns"), F.lit(False))).alias("deleted"))


def segments(own: list[tuple], kept_ns: int) -> Iterator[tuple[int, int, str, bool]]:
    """(since, until, uid, early) of one address. own: its claims as (since, -version, uid, gone, deleted)."""
    own = sorted(own)
    times = sorted({t for since, _, _, gone, deleted in own for t in (since, gone, gone + kept_ns if deleted else gone)} - {NEVER})
    live, gone_ones, k, spans = [], [], 0, [[ALWAYS, None]]
    for t in times:
        while k < len(own) and own[k][0] <= t:
            since, version, uid, gone, deleted = own[k]
            heapq.heappush(live, (-since, version, uid, gone, deleted))
            k += 1
        while live and live[0][3] <= t:
            _, version, uid, gone, deleted = heapq.heappop(live)
            if deleted:
                heapq.heappush(gone_ones, (version, uid, gone + kept_ns))
        while gone_ones and gone_ones[0][2] <= t:
            heapq.heappop(gone_ones)
        holder = live[0][2] if live else gone_ones[0][1] if gone_ones else None
        if holder != spans[-1][1]:
            spans.append([t, holder])
    for (since, uid), (until, after) in zip(spans, [*spans[1:], [NEVER, None]], strict=True):
        if uid is not None or after is not None:
            yield since, until, uid if uid is not None else after, uid is None


def address_history(pods: DataFrame, kept_ns: int = TOMBSTONE_NS) -> DataFrame:
    """Disjoint intervals of each address, [since_ns, until_ns): ip, since_ns, until_ns, uid, early. kept_ns: how long tombstones answer."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def run(batches):
        out: list[tuple] = []
        for ip, own in groupby(rows(batches), key=lambda r: r[0]):
            out += [(ip, *s) for s in segments([(since, -version, uid, gone, deleted) for _, uid, version, since, gone, deleted in own], kept_ns)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    return claims(pods).repartition("ip").sortWithinPartitions("ip").mapInArrow(run, SEGMENT)


def address_state(pods: DataFrame, kept_ns: int = TOMBSTONE_NS) -> DataFrame:
    """The columns of address_history where pods is a state, no log: one interval for each address, its last pod's (dims.one_by_ip), up to the end of its tombstone."""
    end = F.coalesce(F.col("deleted_at") + kept_ns, F.lit(NEVER))
    return one_by_ip(latest(pods, "uid")).select("ip", F.lit(ALWAYS).alias("since_ns"), end.alias("until_ns"), "uid", F.lit(False).alias("early"))


def as_of(rows: DataFrame, intervals: DataFrame, key: str, at: str, bucket_ns: int, answer: str = "answer") -> DataFrame:
    """rows with the interval (a struct, or null) of the same key that holds at their time, by one sorted pass over both.

    intervals: key, since_ns, until_ns and more, disjoint by key. Rows and the starts of intervals meet in buckets of time, so a key
    of any number of rows is spread over many tasks; each bucket with rows first gets the interval that was running when it began.
    """
    bucket = lambda c: F.expr(f"{c} div {bucket_ns}")
    asked = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), bucket(f"`{at}`").alias("__bucket"), F.lit(1).alias("__kind"), F.struct("*").alias("__row"))
    known = intervals.select(F.col(key).alias("__key"), F.col("since_ns").alias("__at"), bucket("since_ns").alias("__bucket"), F.lit(0).alias("__kind"), F.struct("*").alias("__seg"))
    # the last interval that begins before each bucket with rows
    wanted = asked.where("__key IS NOT NULL AND __at IS NOT NULL").select("__key", "__bucket").distinct()
    last = known.groupBy("__key", "__bucket").agg(F.max_by("__seg", "__at").alias("__seg"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    both = wanted.withColumn("__want", F.lit(True)).join(last, ["__key", "__bucket"], "full")
    carried = both.withColumn("__seg", F.last("__seg", ignorenulls=True).over(before)).where("__want AND __seg IS NOT NULL")
    carried = carried.select("__key", F.lit(ALWAYS).alias("__at"), "__bucket", F.lit(0).alias("__kind"), "__seg")
    order = Window.partitionBy("__key", "__bucket").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    some = asked.where("__key IS NOT NULL AND __at IS NOT NULL")
    merged = some.unionByName(known.unionByName(carried), allowMissingColumns=True).withColumn("__seg", F.last("__seg", ignorenulls=True).over(order)).where("__kind = 1")
    none = asked.where("__key IS NULL OR __at IS NULL").select("__row", F.lit(None).cast(merged.schema["__seg"].dataType).alias("__seg"), "__at")
    found = merged.select("__row", "__seg", "__at").unionByName(none)
    return found.select("__row.*", F.when(F.col("__seg.until_ns") > F.col("__at"), F.col("__seg")).alias(answer))


def covers(at: Column, since: Column, until: Column) -> Column:
    return (since <= at) & (at < until)
