"""Files of fixed-size kernel records as a data source: batch and stream reads by ranges of records, and writes.

    spark.read.format("flow_records").load(path)          spark.readStream.format("flow_records").load(path)
    rows.write.format("flow_records").save(path)

A range of records is one partition, decoded by numpy into the columns that the schema asks for, so switched-off features are never
decoded: record_schema() gives schemas with and without them. The offset of a stream is the number of whole records read of each
file; files may grow, and a record that is still being written waits. Written files get their names when the job commits, so retried
tasks leave nothing behind. Paths are local or shared ones, or URIs that pyarrow's file systems know.

Defined results: a file shorter than a record has none; integers too large for a long (unsigned, over 2 ** 63) come as negative ones.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

# The layout of a flow record (little-endian, aligned as the kernel side does): column, offset, kind, how many.
FLOW_FIELDS = [
    ("timestamp_ns", 0, "u8", 1), ("code", 8, "u4", 1), ("pid", 12, "u4", 1), ("tgid", 16, "u4", 1), ("cgroup_id", 24, "u8", 1), ("netns_ino", 32, "u8", 1), ("family", 40, "u2", 1), ("proto", 42, "u1", 1),
    ("src_addr", 44, "u4", 1), ("dst_addr", 48, "u4", 1), ("src_port", 52, "u2", 1), ("dst_port", 54, "u2", 1), ("bytes_sent", 56, "u8", 1), ("bytes_recv", 64, "u8", 1), ("packets_sent", 72, "u8", 1), ("packets_recv", 80, "u8", 1),
    ("size_counts", 88, "u8", 7), ("iat_counts", 144, "u8", 6), ("size_min", 192, "u8", 1), ("size_max", 200, "u8", 1), ("idle_gap_count", 208, "u8", 1), ("burst_count", 216, "u8", 1), ("real_packets_sent", 224, "u8", 1), ("real_packets_recv", 232, "u8", 1),
    ("syn_count", 240, "u4", 1), ("fin_count", 244, "u4", 1), ("rst_count", 248, "u4", 1), ("traffic_accounting_available", 252, "u1", 1), ("packet_timing_available", 253, "u1", 1), ("tcp_metrics_available", 254, "u1", 1),
]
FLOW_BYTES = 256
SIZE_FIELDS, TIMING_FIELDS = ("size_counts", "size_min", "size_max"), ("iat_counts", "idle_gap_count", "burst_count")
FLAG_FIELDS = ("traffic_accounting_available", "packet_timing_available", "tcp_metrics_available")
#: Records of a partition, and of a batch inside it.
PARTITION_RECORDS, BATCH_RECORDS = 250_000, 50_000

FLOW_RECORD = np.dtype({"names": [f[0] for f in FLOW_FIELDS], "offsets": [f[1] for f in FLOW_FIELDS], "formats": [f"<{k}" if n == 1 else (f"<{k}", n) for _, _, k, n in FLOW_FIELDS], "itemsize": FLOW_BYTES})


def record_schema(sizes: bool = True, timing: bool = True, place: bool = True) -> T.StructType:
    """Columns of a flow record; without sizes or timing those aren't decoded. place: file and record, the position of a row."""
    off = {*(() if sizes else SIZE_FIELDS), *(() if timing else TIMING_FIELDS)}
    kind = lambda name, n: T.ArrayType(T.LongType()) if n > 1 else T.BooleanType() if name in FLAG_FIELDS else T.IntegerType() if name in ("code", "family", "proto", "src_port", "dst_port") else T.LongType()
    fields = [T.StructField(name, kind(name, n)) for name, _, _, n in FLOW_FIELDS if name not in off]
    return T.StructType(fields + ([T.StructField("file", T.StringType()), T.StructField("record", T.LongType())] if place else []))


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}[kind]


def decoded(data: bytes, schema: T.StructType, file: str, first: int) -> pa.RecordBatch:
    rows = np.frombuffer(data, dtype=FLOW_RECORD)
    columns = []
    for f in schema.fields:
        if f.name == "file":
            columns.append(pa.array([file] * len(rows), pa.string()))
        elif f.name == "record":
            columns.append(pa.array(np.arange(first, first + len(rows))))
        elif isinstance(f.dataType, T.ArrayType):
            v = rows[f.name].astype(np.int64)
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel())))
        elif isinstance(f.dataType, T.BooleanType):
            columns.append(pa.array(rows[f.name] != 0))
        else:
            columns.append(pa.array(rows[f.name].astype(np.int64)).cast(arrow_type(f.dataType)))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def encoded(batch: pa.RecordBatch) -> bytes:
    """Records of a batch; columns that it lacks, and nulls, are zero."""
    rows = np.zeros(batch.num_rows, dtype=FLOW_RECORD)
    for name, _, kind, n in FLOW_FIELDS:
        if name in batch.schema.names:
            column = batch.column(name)
            if n > 1:
                for k, v in enumerate(column.to_pylist()):
                    rows[name][k, : len(v or ())] = v or ()
            else:
                rows[name] = np.array([int(v or 0) for v in column.to_pylist()], dtype=np.int64).astype(f"<{kind}")
    return rows.tobytes()


def files_of(path: str) -> dict[str, int]:
    """Whole records by file, in order of their names; hidden and temporary ones aside."""
    fs, base = located(path)
    info = fs.get_file_info(base)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return {i.path: i.size // FLOW_BYTES for i in sorted(found, key=lambda i: i.path) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Records(InputPartition):
    file: str
    first: int
    last: int  #: after the last one


def ranges(start: dict[str, int], end: dict[str, int], size: int) -> list[Records]:
    out = []
    for file, last in sorted(end.items()):
        first = start.get(file, 0)
        out += [Records(file, k, min(k + size, last)) for k in range(first, last, size)]
    return out


def read_records(path: str, schema: T.StructType, part: Records) -> Iterator[pa.RecordBatch]:
    fs, _ = located(path)
    with fs.open_input_file(part.file) as f:
        for first in range(part.first, part.last, BATCH_RECORDS):
            n = min(BATCH_RECORDS, part.last - first)
            yield decoded(f.read_at(n * FLOW_BYTES, first * FLOW_BYTES), schema, part.file, first)


class FlowRecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("recordsperpartition", PARTITION_RECORDS))

    def partitions(self) -> list[Records]:
        return ranges({}, files_of(self.path), self.size) or [Records("", 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if partition.last > partition.first:
            yield from read_records(self.path, self.schema, partition)


class FlowRecordStreamReader(DataSourceStreamReader):
    """maxRecordsPerTrigger: about how many records a micro-batch takes at most (whole numbers of a file's records; 0: all)."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.size, self.most = int(options.get("recordsperpartition", PARTITION_RECORDS)), int(options.get("maxrecordspertrigger", 0))
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now, left = files_of(self.path), self.most
        for file, n in now.items():
            before = self.at.get(file, 0)
            if self.most:
                n = min(n, before + left)
                left -= n - before
            self.at[file] = max(n, before)
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[Records]:
        self.at = {f: max(n, self.at.get(f, 0)) for f, n in end.items()}
        return ranges(start, end, self.size)

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        yield from read_records(self.path, self.schema, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    records: int


class FlowRecordWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator) -> Written:
        fs, base = located(self.path)
        fs.create_dir(base, recursive=True)
        temporary, n = f"{base}/.{uuid.uuid4().hex}.tmp", 0
        with fs.open_output_stream(temporary) as f:
            for batch in iterator:
                f.write(encoded(batch))
                n += batch.num_rows
        return Written(temporary, n)

    def commit(self, messages: list) -> None:
        fs, base = located(self.path)
        old = [*files_of(self.path)] if self.overwrite else []
        job = uuid.uuid4().hex
        for k, m in enumerate(m for m in messages if m):
            if m.records:
                fs.move(m.temporary, f"{base}/part-{k:05d}-{job}.bin")
            else:
                fs.delete_file(m.temporary)
        for file in old:
            fs.delete_file(file)

    def abort(self, messages: list) -> None:
        fs, _ = located(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class FlowRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flow_records"

    def lowered(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> T.StructType:
        return record_schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FlowRecordReader(schema, self.lowered())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return FlowRecordStreamReader(schema, self.lowered())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FlowRecordWriter(self.lowered(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session. Its classes travel by value, so workers need nothing of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FlowRecords)
