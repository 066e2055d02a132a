"""Binary records, rotated files, dimensions and labels in motion."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlens.plans import ledger
from sessionlens.plans.rotation import Rotation, write_rotated
from sessionlens.sources import binary_records as br
from sessionlens.streaming import dimensions as dim

G = 1_000_000_000


# ---- binary records


@pytest.fixture
def records(spark):
    br.register(spark)
    return spark


def rows(spark, start, end):
    return spark.range(start, end, 1, 3).select(F.col("id").alias("timestamp_ns"), (F.col("id") % 4 + 1).cast("int").alias("code"), F.array(*[F.col("id") + k for k in range(7)]).alias("size_counts"), (F.col("id") % 3 == 0).alias("tcp_metrics_available"))


def stream(spark, folder, out, **options):
    source = spark.readStream.format("flow_records").options(**options).load(folder)
    source.select("timestamp_ns", "record").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(r.timestamp_ns for r in spark.read.parquet(f"{out}/rows").collect())


def test_records_round_trip_by_ranges(records, tmp_path):
    folder = str(tmp_path / "in")
    rows(records, 0, 1000).write.format("flow_records").mode("append").save(folder)
    assert all(os.path.getsize(f"{folder}/{f}") % br.FLOW_BYTES == 0 for f in os.listdir(folder)) and not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    df = records.read.format("flow_records").option("recordsPerPartition", 100).load(folder)
    assert df.rdd.getNumPartitions() >= 10
    got = {r.timestamp_ns: (r.code, list(r.size_counts), r.tcp_metrics_available, r.pid) for r in df.collect()}
    assert got == {k: (k % 4 + 1, [k + j for j in range(7)], k % 3 == 0, 0) for k in range(1000)}
    rows(records, 5, 7).write.format("flow_records").mode("overwrite").save(folder)
    assert sorted(r.timestamp_ns for r in records.read.format("flow_records").load(folder).collect()) == [5, 6]


def test_switched_off_features_are_not_decoded(records, tmp_path, monkeypatch):
    folder = str(tmp_path / "in")
    rows(records, 0, 10).write.format("flow_records").mode("append").save(folder)
    narrow = br.record_schema(sizes=False, timing=False, place=False)
    assert not {"size_counts", "size_min", "iat_counts", "burst_count", "file"} & set(narrow.names)
    df = records.read.format("flow_records").schema(narrow).load(folder)
    assert df.columns == narrow.names and df.count() == 10


def test_a_restarted_stream_reads_each_record_once(records, tmp_path):
    """Growing files, a record half written, a limit for each micro-batch."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    data = np.zeros(25, dtype=br.FLOW_RECORD)
    data["timestamp_ns"] = np.arange(25)
    with open(f"{folder}/a.bin", "wb") as f:
        f.write(data[:10].tobytes() + data[10:11].tobytes()[:100])
    assert stream(records, folder, out) == list(range(10))
    assert stream(records, folder, out) == list(range(10))
    with open(f"{folder}/a.bin", "ab") as f:
        f.write(data[10:11].tobytes()[100:] + data[11:20].tobytes())
    with open(f"{folder}/b.bin", "wb") as f:
        f.write(data[20:].tobytes())
    assert stream(records, folder, out, recordsPerPartition=4) == list(range(25))
    limited = str(tmp_path / "limited")
    source = records.readStream.format("flow_records").option("maxRecordsPerTrigger", 7).load(folder)
    seen = []
    q = source.writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", limited).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(seen) == 25 and max(seen) <= 7


def test_no_files_no_records(records, tmp_path):
    os.makedirs(tmp_path / "none")
    assert records.read.format("flow_records").load(str(tmp_path / "none")).count() == 0


# ---- rotation


def test_rotation_rule():
    none = np.full(4, np.nan)
    assert Rotation(10, 0).files(np.array([4, 6, 1, 20]), none).tolist() == [0, 0, 1, 2]
    assert Rotation(1, 0).files(np.array([5, 5]), none[:2]).tolist() == [0, 1]
    assert Rotation(0, 10).files(np.array([1, 1, 1, 1]), np.array([0.0, 9.0, 10.0, 19.0])).tolist() == [0, 0, 1, 1]
    assert Rotation(0, 0).files(np.array([1, 1]), none[:2]).tolist() == [0, 0]


def test_files_rotate_by_size_and_keep_all_lines(spark, tmp_path):
    folder = str(tmp_path / "out")
    lines = spark.range(0, 3000, 1, 3).select(F.concat(F.col("id"), F.lit(" "), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int"))).alias("value"))
    write_rotated(lines, folder, max_bytes=2_000)
    back = []
    for at, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-"):
                assert os.path.getsize(f"{at}/{n}") <= 2_000
                own = open(f"{at}/{n}", encoding="utf-8").read().splitlines()
                assert own == sorted(own, key=lambda x: int(x.split()[0]))
                back += own
    assert sorted(back) == sorted(r.value for r in lines.collect())
    write_rotated(lines.limit(1), folder, max_bytes=1)
    assert spark.read.text(folder).count() == 3001


def test_ledger_rotates_by_age_in_batch_and_stream(spark, tmp_path):
    df = spark.range(0, 10, 1, 1).select(F.col("id").alias("flow_id"), F.lit(None).cast("string").alias("none"), (F.col("id") * 10 * G).alias("at_ns"))
    ledger.write_ledger(df, str(tmp_path / "b"), max_age_ns=30 * G, at="at_ns")
    t = spark.read.text(str(tmp_path / "b"))
    assert [r.n for r in t.groupBy("writer", "file").agg(F.count("*").alias("n")).orderBy("file").collect()] == [3, 3, 3, 1]
    assert json.loads(t.first().value).keys() == {"flow_id", "none"}
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ledger.stream_rotated_ledger(source, str(tmp_path / "s"), str(tmp_path / "c"), max_bytes=60).awaitTermination()
    s = spark.read.text(str(tmp_path / "s"))
    assert s.count() == 10 and s.select("batch").distinct().count() == 1 and s.groupBy("file").count().agg(F.max("count")).first()[0] == 1


# ---- dimensions


SCHEMA = "uid string, address string, version long"


def change(spark, folder, *changes):
    spark.createDataFrame([(u, a, v, d, None if at is None else at * G) for u, a, v, d, at in changes], SCHEMA + ", deleted boolean, changed_ns long").write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    dim.maintain(source, f"{folder}/out", SCHEMA).awaitTermination()
    return {r.uid: (r.address, r.version) for r in dim.current(spark, f"{folder}/out", SCHEMA).collect()}


def test_versions_deletions_and_late_changes(spark, tmp_path):
    folder = str(tmp_path)
    assert change(spark, folder, ("a", "1", 1, False, 1), ("b", "1", 1, False, 1), ("a", "2", 3, False, 2)) == {"a": ("2", 3), "b": ("1", 1)}
    assert change(spark, folder, ("a", "9", 2, False, 3), ("b", "1", 2, True, 3), ("c", "5", 1, None, None)) == {"a": ("2", 3), "c": ("5", 1)}
    assert change(spark, folder, ("b", "late", 1, False, 4)) == {"a": ("2", 3), "c": ("5", 1)}  # the deletion is remembered
    assert change(spark, folder, ("b", "new", 3, False, 5)) == {"a": ("2", 3), "b": ("new", 3), "c": ("5", 1)}
    assert change(spark, folder, ("a", "2", 3, True, 6)) == {"b": ("new", 3), "c": ("5", 1)}
    change(spark, folder, ("z", "", 1, False, 1000))
    assert "a" not in {r.uid for r in dim.with_deleted(spark, f"{folder}/out", SCHEMA).collect()}  # forgotten after five minutes
    assert len(dim.snapshots(spark, f"{folder}/out")) == dim.KEPT_SNAPSHOTS


def test_an_unfinished_snapshot_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    change(spark, folder, ("a", "1", 1, False, 1))
    os.makedirs(f"{folder}/out/snapshot=99")
    assert dim.snapshots(spark, f"{folder}/out") == [0]
    assert dim.current(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_joins_see_the_state_of_their_time(spark, tmp_path):
    """Between two micro-batches a slice moves to another address and its old alias goes."""
    folder, seen = str(tmp_path), []
    flows = spark.createDataFrame([("1",), ("2",)], "address string")

    def look(batch, tables):
        return batch.join(tables["slices"], "address").select("uid", "address")

    for at, address in ((1, "1"), (2, "2")):
        change(spark, folder, ("s", address, at, False, at))
        flows.write.mode("append").parquet(f"{folder}/flows")
        dim.with_dimensions(spark.readStream.schema(flows.schema).parquet(f"{folder}/flows"), {"slices": (f"{folder}/out", SCHEMA)}, look, f"{folder}/joined").awaitTermination()
        seen.append(sorted((r.batch, r.uid, r.address) for r in spark.read.parquet(f"{folder}/joined").collect()))
    assert seen == [[(0, "s", "1")], [(0, "s", "1"), (1, "s", "2")]]


def test_failed_label_reads_keep_the_last_good_ones(spark, tmp_path):
    schema = "document string, read_at long, ok boolean, experiment_id string, scenario_label string"
    held = "document string, experiment_id string, scenario_label string, version long"
    for read_, want in ((("d", 1, True, "x", "load"), "x"), (("d", 2, False, None, None), "x"), (("d", 3, True, "y", ""), "y")):
        spark.createDataFrame([read_], schema).write.mode("append").parquet(f"{tmp_path}/reads")
        dim.watched_labels(spark.readStream.schema(schema).parquet(f"{tmp_path}/reads"), f"{tmp_path}/held").awaitTermination()
        assert [r.experiment_id for r in dim.current(spark, f"{tmp_path}/held", held).collect()] == [want]
