"""Drifting gates: a row passes if it comes an interval or more after the last one that passed, so the gates follow no grid.

One pass over the rows of each group in order. The next gate is found by a search in the sorted times, so a batch costs a step for
each row that passes; between batches only the last gate is kept, so a group of any length takes no more memory than a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passing(times: np.ndarray, gates: np.ndarray, last: int, interval: int) -> tuple[list[int], int]:
    """Places (of the sorted times) that pass, and the last gate then. gates: places that may pass, all after the row that set last."""
    own, out, i = times[gates], [], 0
    while (i := max(i, int(np.searchsorted(own, last + interval, side="left")))) < len(own):
        out.append(int(gates[i]))
        last = int(own[i])
        i += 1
    return out, last


def drifting_gates(rows: DataFrame, group: list[str], place: str, at: str, opens: Column, gate: Column, interval: int) -> DataFrame:
    """group, place, n: the rows that pass, numbered from 1.

    place numbers the rows of a group from 1 on, in order of at. The first row where opens holds sets the gate and doesn't pass;
    later ones pass where gate holds and at is at least the interval after the last that passed.
    """
    narrow = rows.select(*group, F.col(place).alias("__place"), F.col(at).alias("__at"), F.coalesce(opens, F.lit(False)).alias("__opens"), F.coalesce(gate, F.lit(False)).alias("__gate"))
    kinds = dict(rows.select(*group).dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in group], f"`{place}` long", "n int"])

    def run(batches):
        last, n = None, 0
        for batch in batches:
            places, times, opening, may = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__place", "__at", "__opens", "__gate"))
            hits, numbers = [], []
            edges = [0, *[k for k in np.flatnonzero(places == 1).tolist() if k], len(places)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start < end and places[start] == 1:
                    last, n = None, 0
                first = 0
                if last is None:
                    openers = np.flatnonzero(opening[start:end])
                    if not len(openers):
                        continue
                    first, last = int(openers[0]) + 1, int(times[start + openers[0]])
                found, last = passing(times[start:end], first + np.flatnonzero(may[start + first : end]), last, interval)
                hits += [start + k for k in found]
                numbers += range(n + 1, n + len(found) + 1)
                n += len(found)
            if hits:
                out = batch.take(pa.array(hits))
                yield pa.RecordBatch.from_arrays([*[out.column(c) for c in group], out.column("__place").cast(pa.int64()), pa.array(numbers, pa.int32())], names=[*group, place, "n"])

    return narrow.repartition(*group).sortWithinPartitions(*group, "__place").mapInArrow(run, schema)
