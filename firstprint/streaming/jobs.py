"""Structured Streaming forms of the incremental ingest and of the intraday roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firstprint.schemas import BAR_SCHEMA
from firstprint.session import materialise
from firstprint.sources.tables import path_exists


def bar_stream(spark: SparkSession, path: str, schema=BAR_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def first_arrivals(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Drops repeats of (symbol, ts) inside the watermark; the first arrival stays."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def ingest_latest(stream: DataFrame, path: str, checkpoint: str, batches_per_day: str = "day") -> StreamingQuery:
    """Last arrival wins: each micro-batch is merged into the day partitions it touches.

    Only the touched days are read and rewritten; a batch that is run again after a failure gives
    the same files, so the sink is idempotent.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = materialise(
            batch.withColumns({"_seq": F.lit(batch_id + 1).cast("bigint"), "_in": F.monotonically_increasing_id(),
                               batches_per_day: F.to_date("ts")}), "batch")
        days = fresh.select(batches_per_day).distinct()
        if days.isEmpty():
            return
        rows = fresh
        if path_exists(spark, path):
            stored = spark.read.schema(fresh.drop("_seq", "_in").schema).parquet(path)
            # the list of touched days is bounded by the calendar
            kept = stored.join(F.broadcast(days), batches_per_day, "left_semi").withColumns(
                {"_seq": F.lit(0).cast("bigint"), "_in": F.lit(0).cast("bigint")})
            rows = kept.unionByName(fresh)
        body = [c for c in batch.columns if c not in ("symbol", "ts")]
        merged = materialise(
            rows.groupBy(batches_per_day, "symbol", "ts").agg(F.max_by(F.struct(*body), F.struct("_seq", "_in")).alias("_b"))
            .select("symbol", "ts", "_b.*", batches_per_day), "merged")
        # rebalance: one file per small day, but a hot day is split over many tasks
        (merged.hint("rebalance", batches_per_day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(batches_per_day).parquet(path))

    return (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_rollup(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Day open, close, high, low and volume per symbol; later than the watermark is dropped."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "symbol")
        .agg(F.min_by("open", "ts").alias("day_open"), F.max_by("close", "ts").alias("day_close"),
             F.max("high").alias("day_high"), F.min("low").alias("day_low"), F.sum("volume").alias("day_volume"))
        .select("symbol", F.to_date("w.start").alias("d"), "day_open", "day_close", "day_high", "day_low", "day_volume")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is available into Parquet and stops."""
    (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
