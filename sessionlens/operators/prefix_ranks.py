"""Exact order statistics of growing prefixes: the r-th smallest of a group's values up to a step, for many steps at once.

Values are taken apart into digits of DIGIT bits. At each digit, from the highest on, a group's rows are counted by digit in order
of their steps, and a query goes down to the digit where the running counts reach its rank, with the rank that is left. The rows
below one digit are a group of their own at the next one. So a query costs a search in one table of counts for each digit, however
long its prefix is; a task holds one such table, and beyond the first digit a large group is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 14


def descend(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """One digit. samples: g, prefix, digit, step, n; queries: g, prefix, step, rank, left. Gives queries with longer prefixes."""
    a = samples.select("g", "prefix", "step", F.lit(0).alias("kind"), F.col("digit").cast("long").alias("a"), F.col("n").alias("b"))
    q = queries.select("g", "prefix", "step", F.lit(1).alias("kind"), F.col("rank").alias("a"), F.col("left").alias("b"))
    rows = a.unionByName(q).repartition("g", "prefix").sortWithinPartitions("g", "prefix", "step", "kind")

    def run(batches):
        held, counts = None, np.zeros(1 << DIGIT, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            g, prefix = batch.column("g"), batch.column("prefix").to_numpy()
            step, kind, a, b = (batch.column(c).to_numpy() for c in ("step", "kind", "a", "b"))
            codes = g.dictionary_encode().indices.to_numpy()
            new = (np.diff(codes) != 0) | (np.diff(prefix) != 0)
            # runs of one group, kind and (queries) step
            cuts = np.flatnonzero(new | (np.diff(kind) != 0) | ((kind[1:] == 1) & (np.diff(step) != 0))) + 1
            fresh = np.concatenate([[False], new])
            places, digits, lefts = [], [], []
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if fresh[start] or (start == 0 and (g[0].as_py(), int(prefix[0])) != held):
                    counts[:] = 0
                if kind[start] == 0:
                    np.add.at(counts, a[start:end], b[start:end])
                else:
                    upto = np.cumsum(counts)
                    digit = np.searchsorted(upto, b[start:end], side="right")
                    places.append(np.arange(start, end))
                    digits.append(digit)
                    lefts.append(b[start:end] - np.where(digit > 0, upto[digit - 1], 0))
            held = (g[batch.num_rows - 1].as_py(), int(prefix[-1]))
            if places:
                at = np.concatenate(places)
                out = [g.take(pa.array(at)), pa.array((prefix[at] << DIGIT) | np.concatenate(digits)), pa.array(step[at]), pa.array(a[at]), pa.array(np.concatenate(lefts))]
                yield pa.RecordBatch.from_arrays(out, names=["g", "prefix", "step", "rank", "left"])

    return rows.mapInArrow(run, "g string, prefix long, step long, rank long, left long")


def prefix_ranks(samples: DataFrame, queries: DataFrame) -> DataFrame:
    """g, step, rank, value: the value of that rank (from 0) among the group's samples of steps up to that one.

    samples: g, step, value, n (how often); queries: g, step, rank; ranks lie below the number of samples so far. The values of all
    groups span less than 2 ** 60. samples is read once for each digit: store it where it isn't cheap.
    """
    low, high = samples.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return queries.select("g", F.col("step").cast("long").alias("step"), "rank", F.lit(None).cast("long").alias("value")).limit(0)
    digits = max(1, -(-int(high - low).bit_length() // DIGIT))
    found = queries.select("g", F.lit(0).cast("long").alias("prefix"), F.col("step").cast("long").alias("step"), F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("left"))
    for k in reversed(range(digits)):
        u = F.col("value") - low
        level = samples.select("g", F.shiftright(u, DIGIT * (k + 1)).alias("prefix"), (F.shiftright(u, DIGIT * k) % (1 << DIGIT)).cast("int").alias("digit"), F.col("step").cast("long").alias("step"), "n")
        level = level.groupBy("g", "prefix", "digit", "step").agg(F.sum("n").cast("long").alias("n"))
        found = descend(level, found)
    return found.select("g", "step", "rank", (F.col("prefix") + low).alias("value"))
