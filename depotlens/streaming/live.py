"""Live request metrics.  The same functions serve tables and streams.

For a stream, pass ``watermark``; results are then emitted in append mode once
their window is complete, and rows later than the watermark are dropped by
Spark.  Where nothing may be lost, whatever the order of arrival, follow the
stream with :func:`start_counts` and read it with :func:`read_per_second`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depotlens.functions.percentiles import count_profile, floor_index, value_counts
from depotlens.functions.sketches import merged_sketch, narrowed_percentiles, value_sketch


def _watermarked(df: DataFrame, watermark: str | None) -> DataFrame:
    return df.withWatermark("ts", watermark) if watermark else df


def _outcomes() -> dict[str, tuple[Column, str]]:
    return {
        "success": (F.count_if(F.col("status") == "success"), "sum"),
        "throttle": (F.count_if(F.col("status") == "throttled"), "sum"),
    }


def window_counts(requests: DataFrame, width: str = "1 second") -> DataFrame:
    """Requests per (window, latency value) and outcome; partial counts of a window add up."""
    return value_counts(requests.withColumn("w", F.window("ts", width)), "latency_ms", ["w"], _outcomes())


def _seconds(counts: DataFrame) -> DataFrame:
    table = counts.groupBy("w").agg(*count_profile(_outcomes()))
    return table.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("second_start"),
        (F.col("success") + F.col("throttle")).alias("rps"), "success", "throttle",
        *[floor_index(p).alias(f"p{p}_ms") for p in (50, 95)],
    )


def per_second(requests: DataFrame, watermark: str | None = None, width: str = "1 second") -> DataFrame:
    """Rate, outcomes and floor-index percentiles of each second.

    ``rps`` counts successes and throttles only; the percentiles cover every
    request.  State holds counts per (second, latency value) rather than every
    latency.
    """
    return _seconds(window_counts(_watermarked(requests, watermark), width))


def start_counts(
    requests: DataFrame, path: str, checkpoint: str, width: str = "1 second", available_now: bool = True
) -> StreamingQuery:
    """Writes the counts of every micro-batch to its own folder below ``path``.

    There is no state and no watermark: a late request adds to its window in
    the files, so none is dropped and the newest window is there as well.  A
    repeated batch overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        window_counts(batch, width).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_per_second(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`per_second` gives for all requests counted so far."""
    parts = spark.read.parquet(path)
    merged = parts.groupBy("w", "v").agg(*[F.sum(c).alias(c) for c in ("n", "success", "throttle")])
    return _seconds(merged)


def start_sketches(
    requests: DataFrame, value: str, path: str, checkpoint: str, width: str = "1 second", available_now: bool = True
) -> StreamingQuery:
    """For values too fine to count one by one, such as fractional latencies.

    A micro-batch writes one bounded sketch a window, and its values as they are, in the order of the windows, for
    the second pass.  A repeated batch overwrites both folders; a late value adds to its window.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.select(F.window("ts", width).alias("w"), F.col(value).alias("v"))
        seen.write.mode("overwrite").parquet(f"{path}/values/batch_id={batch_id}")
        seen.groupBy("w").agg(*value_sketch("v")).write.mode("overwrite").parquet(f"{path}/sketches/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_window_percentiles(spark: SparkSession, path: str, ps: Sequence[int], rule: str = "floor") -> DataFrame:
    """Exact percentiles of each window of :func:`start_sketches`; the merged sketches say which values to rank."""
    merged = spark.read.parquet(f"{path}/sketches").groupBy("w").agg(*merged_sketch())
    exact = narrowed_percentiles(spark.read.parquet(f"{path}/values"), "v", ["w"], ps, rule, merged)
    return exact.select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *[f"p{p}" for p in ps])


def interval_deltas(requests: DataFrame, watermark: str | None = None, seconds: int = 5) -> DataFrame:
    """What each run added per interval; adding them up again gives its totals."""
    return _watermarked(requests, watermark).groupBy(
        "run_id", F.window("ts", f"{seconds} seconds").alias("w")
    ).agg(
        F.count(F.lit(1)).alias("d_total"),
        F.count_if(F.col("status") != "throttled").alias("d_success"),
        F.count_if(F.col("status") == "throttled").alias("d_throttle"),
    ).select(
        "run_id", F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("until"),
        "d_total", "d_success", "d_throttle",
    )


def per_minute(requests: DataFrame, watermark: str | None = None) -> DataFrame:
    """Per-second rates averaged over each minute (window sum / 60) and mean latency."""
    return _watermarked(requests, watermark).groupBy(
        "variant", F.window("ts", "1 minute").alias("w")
    ).agg(
        F.round(F.count_if(F.col("status") == "success") / 60, 6).alias("consumed_per_second"),
        F.round(F.count_if(F.col("status") == "throttled") / 60, 6).alias("throttled_per_second"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    ).select(
        "variant", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("minute_start"),
        "consumed_per_second", "throttled_per_second", "avg_latency_ms",
    )
