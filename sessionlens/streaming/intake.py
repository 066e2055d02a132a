"""What a stream takes in: rows in time go on to the operators, late ones to a side table.

A stateful operator drops what is older than its watermark without a word. Here the watermark is kept beside the tables: before a
micro-batch it is the latest event time of all earlier ones less the delay, and rows older than that are late. Whatever reads the
accepted rows with the same delay sees no late row, as its own watermark never runs ahead. Each micro-batch has folders of its own,
which are skipped where a retry finds them complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def complete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def written_once(df: DataFrame, folder: str) -> None:
    if not complete(df.sparkSession, folder):
        df.write.mode("overwrite").parquet(folder)


def accept(events: DataFrame, folder: str, delay_ns: int, at: str = "timestamp_ns", once: bool = True) -> StreamingQuery:
    """Starts a query that splits a stream: folder/accepted and folder/late (both by batch), folder/clock. once: what is there, then end."""

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if complete(spark, f"{folder}/clock/batch={number}"):
            return
        clock = None
        if number:
            earlier = spark.read.schema("latest long, batch long").parquet(f"{folder}/clock").where(F.col("batch") < number)
            clock = earlier.agg(F.max("latest")).first()[0]
        late = F.lit(False) if clock is None else F.coalesce(F.col(at) < clock - delay_ns, F.lit(False))
        marked = batch.withColumn("__late", late)
        written_once(marked.where("NOT __late").drop("__late"), f"{folder}/accepted/batch={number}")
        written_once(marked.where("__late").drop("__late"), f"{folder}/late/batch={number}")
        written_once(batch.agg(F.max(at).cast("long").alias("latest")), f"{folder}/clock/batch={number}")

    writer = events.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/intake")
    return (writer.trigger(availableNow=True) if once else writer).start()


def accepted(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """The rows in time, as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{folder}/accepted/batch=*")


def late(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came too late, with their batch."""
    return spark.read.parquet(f"{folder}/late")
