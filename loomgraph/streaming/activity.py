"""Counts of arriving events per window and type, kept up to date while the stream runs.

Each micro-batch writes the windows that it changed under its own number, overwriting what a failed try of the same batch
left, so a restart from the checkpoint repeats nothing. A window's row of the highest batch is its state. Events later than
``late`` behind the newest are no longer counted, which bounds the state; ``late=None`` keeps all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, n, total of the events (event_id, event_type, ts, value) by window; null times are in none."""
    timed = events.where("ts is not null")
    timed = timed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else timed
    counts = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def keep(counts: DataFrame, path: str) -> StreamingQuery:
    """Run the stream over all that has arrived and write changed windows to ``path``."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start()


def state(spark: SparkSession, path: str) -> DataFrame:
    """Each window as its last batch left it."""
    rows = spark.read.parquet(f"{path}/rows")
    last = Window.partitionBy("start", "event_type").orderBy(F.col("batch").desc())
    return rows.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "batch")
