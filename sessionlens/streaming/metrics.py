"""Counters of running streams: observed metrics of each micro-batch, added up, and the number of open sessions.

observed() hangs the counters of records on a stream without another pass; Counters adds them up as a query listener, each
micro-batch once, and totals() does so from a query's own progress. Open sessions are rows of the stateful operator's state, read from its
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(records: DataFrame, name: str = "records") -> DataFrame:
    """records that are counted as they pass: emitted, unknown_src, unknown_dst, external_dst, reviews."""
    unknown = lambda c: F.count_if(F.col(c) == "unknown")
    return records.observe(name, F.count(F.lit(1)).alias("emitted"), unknown("src_mapping_confidence").alias("unknown_src"), unknown("dst_mapping_confidence").alias("unknown_dst"), F.count_if("dst_external").alias("external_dst"), F.count_if("review_required").alias("reviews"))


def observed_events(events: DataFrame, name: str = "events") -> DataFrame:
    """events that are counted by their type as they pass; drops by what they count."""
    kinds = ("CONNECT", "ACCEPT", "STATS", "CLOSE", "TLS_HANDSHAKE", "DROP")
    return events.observe(name, *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.coalesce(F.sum(F.when(F.col("event_type") == "DROP", F.col("drop_count"))), F.lit(0)).alias("dropped"))


def added(total: dict[str, int], row) -> dict[str, int]:
    values = row.asDict() if hasattr(row, "asDict") else dict(row)
    return {k: total.get(k, 0) + (v or 0) for k, v in values.items()}


def totals(progress: Iterable, name: str) -> dict[str, int]:
    """The counters of all micro-batches of a query (its recentProgress); of a batch tried again the last counts."""
    rows = {p["batchId"] if isinstance(p, dict) else p.batchId: (p["observedMetrics"] if isinstance(p, dict) else p.observedMetrics).get(name) for p in progress}
    out: dict[str, int] = {}
    for row in rows.values():
        if row is not None:
            out = added(out, row)
    return out


class Counters(StreamingQueryListener):
    """Live counters of all queries of a session: value(name) at any time. spark.streams.addListener(Counters())."""

    def __init__(self):
        self.seen: dict[tuple, dict] = {}
        self.finished = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            self.seen[name, str(p.id), p.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.finished += 1

    def value(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for (n, _, _), row in self.seen.items():
            if n == name:
                out = added(out, row)
        return out


def open_sessions(spark: SparkSession, checkpoint: str) -> int:
    """How many sessions a stream's state holds after its last micro-batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "head").load()
    return state.count()
