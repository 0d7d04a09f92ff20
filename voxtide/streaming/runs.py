"""Running streams to a table: landing input, draining what is available, reading the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators.jobs import current_jobs, job_summary
from voxtide.operators.listing import pending_work
from voxtide.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on storage that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str, order: list[str] | None = None, batches: int = 3) -> DataFrame:
    """Writes a batch as files and opens them as a stream of one file per micro-batch.

    Rows are dealt to the ``batches`` files by a hash of ``order``, so that the stream meets them far out of order.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    # Fixed numbers of files and of files per trigger: the stream is the same on any cluster.
    dealt = df.repartition(batches, *order) if order else df.coalesce(1)
    dealt.write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all available input into a table and reads it.

    Only batches with data are run: state that waits for the clock would ask for empty ones without end.
    """
    spark = stream.sparkSession
    out = new_folder(spark, name)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", out + "-state")
            .option("path", out)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(out)


def latest_by_key(
    stream: DataFrame, keys: list[str], values: list[str], order: str, name: str, generation: int | None = None
) -> DataFrame:
    """Latest-wins coalescing: each micro-batch is reduced to one row per key before it is kept.

    With ``generation``, rows whose column of that name has another value are dropped first. Batches are stored by their number, so one that runs again after a failure replaces itself; the read takes the
    newest row per key over the batches.
    """
    spark = stream.sparkSession
    out = new_folder(spark, name)
    stream = stream if generation is None else stream.filter(F.col("generation") == generation)

    def newest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"), F.max(order).alias(order))
        return best.select(*keys, order, *[F.col(f"_v.{v}").alias(v) for v in values])

    def keep(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return newest(spark.read.parquet(out).drop("batch"))


def batch_snapshots(events: DataFrame, name: str) -> DataFrame:
    """Counters of every batch as the stream goes: running state per job, then counts.

    The stream keeps one aggregate per job (the ``update`` rows of a micro-batch are the jobs that changed).
    """
    spark = events.sparkSession
    out = new_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        current_jobs(events)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", out + "-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    jobs = rows.groupBy("batch_id", "job_id").agg(F.max_by("state", "batch").alias("state"))
    return job_summary(jobs)


def incremental(stream: DataFrame, done: DataFrame, policy: str, name: str) -> DataFrame:
    """Only the work items of a stream that have no output yet, against the outputs that exist when a batch runs."""
    return drain(pending_work(stream, done, policy), name)
