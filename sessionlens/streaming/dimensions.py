"""Dimensions kept up to date from change streams, and joins that see each new state.

A change row has an id, a version and whether it deletes; the highest version of an id holds, whatever the order of arrival.
maintain() merges every micro-batch of changes into a new snapshot: a folder of its own that counts once Spark has marked it
complete, so readers see the state before or after, never one between. What a row owns (the endpoints of a slice, the ports of a
service) is part of it and goes with it. Deletions stay as rows for kept_ns of change time, so that late older versions don't bring
an id back. A snapshot is rewritten as a whole: dimensions are small against the events that are joined with them.

with_dimensions() runs a stream's micro-batches against the snapshots that are there when each begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dims import TOMBSTONE_NS

#: So many snapshots stay, for joins that began before the last ones.
KEPT_SNAPSHOTS = 3


def _filesystem(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete snapshots, ascending."""
    fs, path = _filesystem(spark, folder)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("snapshot=")]
    done = [p for p in found if fs.exists(p.suffix("/_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def current(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The live rows of the last snapshot; before the first one none."""
    whole = with_deleted(spark, folder, schema)
    return whole.where("NOT deleted").drop("deleted", "changed_ns")


def with_deleted(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows of the last snapshot, with deleted and changed_ns."""
    numbers = snapshots(spark, folder)
    full = f"{schema}, deleted boolean, changed_ns long"
    reader = spark.read.schema(full)
    return reader.parquet(f"{folder}/snapshot={numbers[-1]}") if numbers else spark.createDataFrame([], full)


def merged(held: DataFrame, changes: DataFrame, key: str, kept_ns: int = TOMBSTONE_NS) -> DataFrame:
    """The highest version of each id (of equal ones a deletion, then the later change); deletions older than kept_ns go."""
    rows = held.unionByName(changes.select(*held.columns))
    order = Window.partitionBy(key).orderBy(F.col("version").desc(), F.col("deleted").desc(), F.col("changed_ns").desc())
    last = rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    now = rows.agg(F.max("changed_ns").alias("__now"))  # one row
    return last.crossJoin(F.broadcast(now)).where("NOT deleted OR changed_ns + {0} >= __now".format(int(kept_ns))).drop("__now")


def maintain(changes: DataFrame, folder: str, schema: str, key: str = "uid", kept_ns: int = TOMBSTONE_NS, once: bool = True) -> StreamingQuery:
    """Starts the query that keeps a dimension: snapshots below folder. changes: the columns of schema, deleted, changed_ns.

    A retried micro-batch finds its snapshot complete and does nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = snapshots(spark, folder)
        if number in done:
            return
        batch = batch.withColumns({"deleted": F.coalesce("deleted", F.lit(False)), "changed_ns": F.coalesce("changed_ns", F.lit(0))})
        merged(with_deleted(spark, folder, schema), batch, key, kept_ns).write.mode("overwrite").parquet(f"{folder}/snapshot={number}")
        fs, _ = _filesystem(spark, folder)
        for old in done[: -KEPT_SNAPSHOTS + 1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot={old}"), True)

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/merging")
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_dimensions(events: DataFrame, tables: dict[str, tuple[str, str]], work: Callable[[DataFrame, dict[str, DataFrame]], DataFrame], out: str, once: bool = True) -> StreamingQuery:
    """Starts a query that writes work(micro-batch, tables) into out (by batch). tables: name -> (folder, schema) of maintained dimensions."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = {name: current(spark, folder, schema) for name, (folder, schema) in tables.items()}
        work(batch, now).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", f"{out}-progress")
    return (writer.trigger(availableNow=True) if once else writer).start()


def watched_labels(reads: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Keeps the last good read of each label document: a failed read (ok false) changes nothing. reads: document, read_at (long), ok and the labels."""
    names = [c for c in reads.columns if c not in ("document", "read_at", "ok")]
    good = reads.where("ok").select("document", *names, F.col("read_at").alias("version"), F.lit(False).alias("deleted"), F.col("read_at").alias("changed_ns"))
    schema = ", ".join(f"{c} {t}" for c, t in good.dtypes if c not in ("deleted", "changed_ns"))
    return maintain(good, folder, schema, key="document", once=once)
