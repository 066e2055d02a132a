"""Numeric expressions: ratios, rates, buckets, percentiles estimated from histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IAT_BOUNDS, IAT_BUCKETS, PACKET_BOUNDS, PACKET_BUCKETS


def safe_ratio(out: Column, in_: Column) -> Column:
    return F.when(in_ != 0, out.cast("double") / in_.cast("double"))


def rate(total: Column, duration_ns: Column) -> Column:
    return F.when(duration_ns > 0, total.cast("double") / (duration_ns.cast("double") / 1e9))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Into [low, high], as far as they are not null; a null value stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low.cast("double")), high.cast("double")))


def packet_bucket(size: Column) -> Column:
    """Index of the size's bucket, from 0; null: null."""
    return reduce(lambda c, k: c.when(size <= PACKET_BOUNDS[k][1], k), range(1, 6), F.when(size <= PACKET_BOUNDS[0][1], 0)).when(size.isNotNull(), 6)


def iat_bucket(us: Column) -> Column:
    """Index of the bucket; bounds belong to the lower one, but 100 isn't below 100. Null: null."""
    return reduce(lambda c, k: c.when(us <= IAT_BOUNDS[k][1], k), range(1, 5), F.when(us < 100, 0)).when(us.isNotNull(), 5)


def _with(value: Column, then) -> Column:
    """then(value), evaluating value once."""
    return F.transform(F.array(value), then)[0]


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)


def histogram_percentile(counts: Column, bounds: list[tuple[int, int]], p: float) -> Column:
    """counts: an array, one count per bucket. Linear inside the bucket where the running count reaches p of all; no data: null."""

    ranges = F.array(*[F.array(F.lit(float(low)), F.lit(float(high))) for low, high in bounds])
    buckets = F.zip_with(counts, ranges, lambda n, r: F.struct(n.alias("n"), r[0].alias("low"), r[1].alias("high")))

    def of(total: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value"))

        def step(acc: Column, b: Column) -> Column:
            reached = acc["seen"] + b["n"]
            here = acc["value"].isNull() & (b["n"] > 0) & (reached >= total * p)
            inside = b["low"] + (total * p - acc["seen"]) / b["n"] * (b["high"] - b["low"])
            return F.struct(reached.alias("seen"), F.when(here, inside).otherwise(acc["value"]).alias("value"))

        return F.aggregate(buckets, zero, step)["value"]

    return _with(total_of(counts).cast("double"), of)


def histogram_mean(counts: Column, bounds: list[tuple[int, int]]) -> Column:
    middles = F.lit([low + (high - low) / 2 for low, high in bounds])
    weighted = F.aggregate(F.zip_with(counts, middles, lambda n, m: n * m), F.lit(0.0), lambda a, x: a + x)
    return weighted / F.nullif(total_of(counts), F.lit(0))


def as_map(counts: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.lit(labels), counts)


def empty_packet_histogram() -> Column:
    return as_map(F.array_repeat(F.lit(0).cast("long"), 7), PACKET_BUCKETS)


def counts_to_map(counts: Column, labels: list[str]) -> Column:
    """An array of bucket counts as a map; all zero: null."""
    return F.when(F.exists(counts, lambda c: c != 0), F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), counts))


__all__ = ["IAT_BOUNDS", "IAT_BUCKETS", "PACKET_BOUNDS", "PACKET_BUCKETS", "as_map", "clamp", "counts_to_map", "empty_packet_histogram", "histogram_mean", "histogram_percentile", "iat_bucket", "packet_bucket", "rate", "safe_ratio"]
