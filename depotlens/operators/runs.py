"""Runs: progress from deltas, roll-ups per layout variant, trends.

A run stands for up to hundreds of thousands of requests, so these tables are
smaller than the log by that factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.scalar import percent, percent_fixed1, round_half_up


def progress_deltas(requests: DataFrame, seconds: int = 5) -> DataFrame:
    """What each worker of a run added in each interval, with a completion mark.

    Only throttles and the rest are told apart, as the load workers do.  The
    last interval of a worker carries ``completed_workers`` = 1.
    """
    step = F.window("ts", f"{seconds} seconds")
    pieces = requests.groupBy("run_id", "worker", step.alias("w")).agg(
        F.count(F.lit(1)).alias("d_total"),
        F.count_if(F.col("status") != "throttled").alias("d_success"),
        F.count_if(F.col("status") == "throttled").alias("d_throttle"),
    ).withColumn("until", F.col("w.end")).drop("w")
    # One row per interval here, so a worker's rows are as few as its intervals.
    newest = F.max("until").over(Window.partitionBy("run_id", "worker"))
    return pieces.select(
        F.col("run_id").alias("execution_id"), "worker", "until", "d_total", "d_success", "d_throttle",
        (F.col("until") == newest).cast("int").alias("completed_workers"),
    )


def run_progress(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters, elapsed seconds and state of every run, from its deltas.

    Missing counters read as 0, a missing worker count as 1.  A running run whose
    workers are all done is COMPLETED.
    """
    sums = deltas.groupBy("execution_id").agg(
        F.sum("d_total").alias("total"), F.sum("d_success").alias("success"),
        F.sum("d_throttle").alias("throttle"), F.max("until").alias("until"),
        F.sum("completed_workers").alias("done"),
    )
    zero = F.lit(0).cast("bigint")
    done = F.coalesce("done", zero)
    elapsed = F.timestamp_diff("SECOND", F.col("started_at"), F.col("until"))
    finished = (F.col("status") == "RUNNING") & (done >= F.coalesce("worker_count", F.lit(1)))
    return runs.join(sums, "execution_id", "left").select(
        "execution_id", "variant", "started_at",
        F.when(finished, "COMPLETED").otherwise(F.col("status")).alias("status"),
        F.coalesce("total", zero).alias("total_requests"),
        F.coalesce("success", zero).alias("success_count"),
        F.coalesce("throttle", zero).alias("throttle_count"),
        F.coalesce(elapsed, zero).alias("elapsed_seconds"),
        done.alias("completed_workers"),
        "declared_rps",
    )


def variant_summary(progress: DataFrame) -> DataFrame:
    """Counters added up over the runs of each variant, with rates and mean duration."""
    total = F.col("total_requests")
    return progress.groupBy("variant").agg(
        F.sum("total_requests").alias("total_requests"),
        F.sum("success_count").alias("success_count"),
        F.sum("throttle_count").alias("throttle_count"),
        round_half_up(F.avg("elapsed_seconds")).cast("string").alias("avg_duration"),
    ).withColumn("success_rate", percent_fixed1(F.col("success_count"), total)).withColumn(
        "error_rate", percent_fixed1(F.col("throttle_count"), total)
    )


def latest_per_variant(progress: DataFrame) -> DataFrame:
    """The newest run of each variant, merged map-side rather than sorted per group."""
    values = [c for c in progress.columns if c not in ("variant", "started_at")]
    latest = progress.groupBy("variant").agg(
        F.max_by(F.struct("started_at", *values), F.struct("started_at", "execution_id")).alias("r")
    )
    return latest.select("variant", "r.*")


def effective_rps(progress: DataFrame) -> DataFrame:
    """Requests per elapsed second, and its share of the declared rate."""
    seconds = F.nullif(F.col("elapsed_seconds"), F.lit(0).cast("bigint"))
    rps = F.coalesce(F.col("total_requests") / seconds, F.lit(0.0))
    return progress.select(
        "execution_id", "variant", "total_requests", "elapsed_seconds",
        round_half_up(rps).alias("effective_rps"),
        F.round(rps / F.col("declared_rps"), 6).alias("declared_share"),
    )


def peak_throughput(requests: DataFrame, unit: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Highest served rate of each run, per second, over windows of ``unit``."""
    per = requests.filter(F.col("status") != "throttled").groupBy(
        "run_id", F.window("ts", unit).alias("w")
    ).agg(F.count(F.lit(1)).alias("served"))
    return per.groupBy(F.col("run_id").alias("execution_id")).agg(
        F.round(F.max("served") / seconds, 6).alias("peak_per_second")
    )


def run_trend(progress: DataFrame, peaks: DataFrame) -> DataFrame:
    """Throttle rate and peak throughput of each run next to the run before it, per variant."""
    before = Window.partitionBy("variant").orderBy("started_at", "execution_id")
    rated = progress.join(peaks, "execution_id", "left").select(
        "execution_id", "variant", "started_at",
        percent(F.col("throttle_count"), F.col("total_requests")).alias("throttle_rate"),
        F.coalesce("peak_per_second", F.lit(0.0)).alias("peak_per_second"),
    )
    return rated.withColumns({
        "previous_rate": F.lag("throttle_rate").over(before),
        "previous_peak": F.lag("peak_per_second").over(before),
    }).withColumn("rate_change", F.round(F.col("throttle_rate") - F.col("previous_rate"), 6))
