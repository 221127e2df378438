"""Program runs and event windows as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.judge import run_code


def job_queue(spark: SparkSession, folder: str, out: str, checkpoint: str, workers: int = 8, schema: str = "id string, code string, language string, stdin string"):
    """Runs every job file that lands in a folder and appends the results; returns the started query. Each micro-batch
    is spread over ``workers`` partitions; a batch that is run again replaces its own output."""
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)

    def run(batch: DataFrame, batch_id: int) -> None:
        run_code(batch.repartition(workers)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and type; works on a stream (with a watermark) and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per user: sessions of events no further apart than the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
