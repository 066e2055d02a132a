"""Rotated files of lines: a new file before a line that would take one over its size, and when one has been open for its age.

Each task writes files of its own, in order of its rows; the rows go on to Spark's writer with the number of their file, so files come
into being by its commit protocol: whole or not at all, once, whatever is retried, on any store.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rotation:
    """The rule, line by line: size and age of the open file, and how many were opened."""

    def __init__(self, max_bytes: int, max_age_ns: int):
        self.max_bytes, self.max_age_ns = max_bytes, max_age_ns
        self.file, self.size, self.opened = 0, 0, None

    def files(self, sizes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The file of each line; sizes with line breaks. A line over the size has a file of its own; times may be null (nan)."""
        out = np.empty(len(sizes), dtype=np.int64)
        for k, (n, at) in enumerate(zip(sizes.tolist(), times.tolist(), strict=True)):
            full = self.max_bytes > 0 and self.size > 0 and self.size + n > self.max_bytes
            old = self.max_age_ns > 0 and self.opened is not None and at == at and at - self.opened >= self.max_age_ns
            if (full or old) and self.size:
                self.file, self.size, self.opened = self.file + 1, 0, None
            if self.opened is None and at == at:
                self.opened = at
            self.size += n
            out[k] = self.file
        return out


def numbered_files(lines: DataFrame, max_bytes: int, max_age_ns: int = 0, value: str = "value", at: str | None = None, order: list[str] | None = None) -> DataFrame:
    """writer, file, place, value: the file of each line of each task. at: the time of a line (ns), whose difference is a file's age."""
    rows = lines.sortWithinPartitions(*order) if order else lines
    rows = rows.select(F.col(value).alias("value"), (F.col(at).cast("double") if at else F.lit(None).cast("double")).alias("at"))

    def run(batches):
        rule, place, writer = Rotation(max_bytes, max_age_ns), 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            files = rule.files(sizes, batch.column("at").to_numpy(zero_copy_only=False))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, writer), pa.int32()), pa.array(files), pa.array(np.arange(place, place + n)), batch.column("value")], names=["writer", "file", "place", "value"])
            place += n

    return rows.mapInArrow(run, "writer int, file long, place long, value string")


def write_rotated(lines: DataFrame, folder: str, max_bytes: int, max_age_ns: int = 0, value: str = "value", at: str | None = None, order: list[str] | None = None, mode: str = "append") -> None:
    """Writes text files below folder/writer=W/file=F, none over max_bytes (0: any size) but for single longer lines."""
    numbered = numbered_files(lines, max_bytes, max_age_ns, value, at, order)
    # in this order already; said so that the writer opens one file after another
    numbered.sortWithinPartitions("writer", "file", "place").select("writer", "file", "value").write.mode(mode).partitionBy("writer", "file").text(folder)
