"""Request-log roll-ups.  Each is one aggregation with map-side partial results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.percentiles import (
    count_profile, floor_index, nearest_rank, profile, ranked_percentiles, value_counts,
)
from depotlens.functions.scalar import (
    iso_instant, mean_rounded, percent, percent_fixed1, percent_whole, round_half_up,
)


def rows() -> Column:
    return F.count(F.lit(1))


def _n(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def count_columns() -> list[Column]:
    return [
        rows().alias("total_requests"),
        _n("success").alias("success_count"),
        _n("throttled").alias("throttle_count"),
        _n("error").alias("error_count"),
    ]


def _only(status: str) -> Column:
    return F.when(F.col("status") == status, F.col("latency_ms"))


# Measures of a request log that can be merged from pieces.
def _measures() -> dict:
    return {
        "success_count": (_n("success"), "sum"),
        "throttle_count": (_n("throttled"), "sum"),
        "error_count": (_n("error"), "sum"),
        "success_sum": (F.sum(_only("success")), "sum"),
        "success_n": (F.count(_only("success")), "sum"),
        "throttled_sum": (F.sum(_only("throttled")), "sum"),
        "throttled_n": (F.count(_only("throttled")), "sum"),
        "first_ts": (F.min("ts"), "min"),
    }


def _mean(total: str, n: str) -> Column:
    mean = F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0).cast("bigint"))
    return F.coalesce(round_half_up(mean), F.lit(0).cast("bigint"))


def _summary_columns() -> list[Column]:
    return [
        F.col("n_rows").alias("total_requests"), "success_count", "throttle_count", "error_count",
        _mean("sum_values", "n_values").alias("avg_latency_ms"),
        *[nearest_rank(p).alias(f"p{p}_latency_ms") for p in (50, 95, 99)],
    ]


def _throttle_rate() -> Column:
    return percent(F.col("throttle_count"), F.col("n_rows")).alias("throttle_rate")


def status_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*count_columns())


def mean_latency(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rounded mean over all, successful and throttled requests; 0 where there are none."""
    return df.groupBy(*by).agg(
        mean_rounded(F.col("latency_ms")).alias("avg_latency_ms"),
        mean_rounded(_only("success")).alias("success_avg_latency_ms"),
        mean_rounded(_only("throttled")).alias("throttled_avg_latency_ms"),
    )


def _whole(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def nearest_rank_percentiles(df: DataFrame, by: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """Fractional values keep their fraction; they are ranked in ranges instead of being counted in one place."""
    if not _whole(df, value):
        return ranked_percentiles(df, value, by, (50, 95, 99), "nearest")
    return profile(df, value, by).select(*by, *[nearest_rank(p).alias(f"p{p}") for p in (50, 95, 99)])


def floor_index_percentiles(df: DataFrame, by: Sequence[str], value: str = "latency_ms") -> DataFrame:
    """As :func:`nearest_rank_percentiles`, by the other rule."""
    if not _whole(df, value):
        return ranked_percentiles(df, value, by, (50, 95, 99), "floor")
    return profile(df, value, by).select(*by, *[floor_index(p).alias(f"p{p}") for p in (50, 95, 99)])


def rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Throttle and success rates in the three display styles."""
    counted = status_counts(df, by)
    total = F.col("total_requests")
    return counted.select(
        *by,
        percent(F.col("throttle_count"), total).alias("throttle_rate"),
        percent_fixed1(F.col("throttle_count"), total).alias("throttle_rate_text"),
        percent_fixed1(F.col("success_count"), total).alias("success_rate_text"),
        percent_whole(F.col("success_count"), total).alias("success_percent"),
        percent_whole(F.col("throttle_count"), total).alias("throttle_percent"),
    )


def round_summary(df: DataFrame) -> DataFrame:
    table = profile(df, "latency_ms", ["run_id", "round"], _measures())
    return table.select(
        "run_id", "round", iso_instant(F.col("first_ts")).alias("started_at"),
        *_summary_columns(), _throttle_rate(),
    )


def run_summary(df: DataFrame) -> DataFrame:
    """Per run from its requests; not an average of its rounds."""
    pieces = value_counts(df, "latency_ms", ["run_id", "variant", "round"], _measures())
    table = pieces.groupBy("run_id", "variant").agg(
        F.size(F.collect_set("round")).cast("bigint").alias("iterations"), *count_profile(_measures())
    )
    return table.select(
        "run_id", "variant", "iterations", *_summary_columns(),
        _mean("success_sum", "success_n").alias("success_avg_latency_ms"),
        _mean("throttled_sum", "throttled_n").alias("throttled_avg_latency_ms"),
    )


def impact_rollup(df: DataFrame) -> DataFrame:
    """Rounds and runs from one pass; ``is_run`` marks the overall rows (round NULL).

    The log shrinks to value counts first; only those are doubled for the two
    grouping sets.
    """
    run, rnd = F.col("run_id"), F.col("round")
    pieces = value_counts(df, "latency_ms", ["run_id", "round"], _measures())
    table = pieces.groupingSets([[run, rnd], [run]], run, rnd).agg(
        (F.grouping("round") == 1).alias("is_run"), *count_profile(_measures())
    )
    return table.select("run_id", "round", "is_run", *_summary_columns(), _throttle_rate())


def second_breakdown(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outcomes per second of a round, rounds merged; ``label`` counts from 1."""
    return df.groupBy(*by, "second").agg(
        _n("success").alias("success"), _n("throttled").alias("throttled"), _n("error").alias("error")
    ).withColumn("label", F.concat((F.col("second") + 1).cast("string"), F.lit("s")))


def load_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Final report of a load script.

    Expects outcomes of the "script" rules: requests that failed otherwise carry
    no status, count in no total, but their latency is in the percentiles.
    """
    table = profile(df, "latency_ms", by, {
        "success": (_n("success"), "sum"), "throttle": (_n("throttled"), "sum"),
    })
    total = F.col("success") + F.col("throttle")
    return table.select(
        *by, total.alias("total"), "success", "throttle",
        percent_fixed1(F.col("success"), total).alias("success_rate"),
        percent_fixed1(F.col("throttle"), total).alias("throttle_rate"),
        *[floor_index(p).alias(f"p{p}_ms") for p in (50, 95, 99)],
        F.when(total == 0, "No requests were completed.").alias("note"),
    )


def hot_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` busiest keys with their share of all requests."""
    counted = df.groupBy(key).agg(rows().alias("requests"))
    # The totals add up the counted keys, whose exchange both branches share.
    everything = counted.agg(F.sum("requests")).scalar()
    return (
        counted.orderBy(F.desc("requests"), key).limit(n)
        .withColumn("share", F.round(F.col("requests") / everything, 6))
    )


def distribution_check(
    df: DataFrame, key: str, targets: Mapping[str, float], tolerance: float
) -> DataFrame:
    """Realised against intended share per key; targets without rows get share 0."""
    wanted = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    counted = df.groupBy(key).agg(rows().alias("n"))
    unseen = df.sparkSession.range(1).select(
        F.explode(F.map_keys(wanted)).alias(key), F.lit(0).cast("bigint").alias("n")
    )
    merged = counted.unionByName(unseen).groupBy(key).agg(F.sum("n").alias("requests"))
    everything = counted.agg(F.sum("n")).scalar()
    share = F.coalesce(F.col("requests") / F.nullif(everything, F.lit(0)), F.lit(0.0))
    target = F.coalesce(F.try_element_at(wanted, F.col(key)), F.lit(0.0))
    return merged.select(
        key, "requests", F.round(share, 6).alias("share"), target.alias("target"),
        (F.abs(share - target) <= tolerance).alias("within_tolerance"),
    )


def overflow(df: DataFrame, key: str, limit: int, unit: str = "second", by: Sequence[str] = ()) -> DataFrame:
    """Demand per key and time unit above a fixed limit: what is served, what is not."""
    per_unit = df.groupBy(*by, key, F.date_trunc(unit, "ts").alias("unit")).agg(rows().alias("n"))
    demand, served = F.sum("n"), F.sum(F.least("n", F.lit(limit)))
    return per_unit.groupBy(*by).agg(
        demand.alias("demand"),
        served.alias("served"),
        F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("rejected"),
        F.count_if(F.col("n") > limit).alias("hot_units"),
    ).withColumn("rejected_percent", percent(F.col("rejected"), F.col("demand")))


def throttle_causes(df: DataFrame) -> DataFrame:
    """Throttled requests per variant and target, split by cause."""
    throttled = F.col("status") == "throttled"
    return df.groupBy("variant", "target").agg(
        F.count_if(throttled & (F.col("cause") == "capacity")).alias("capacity"),
        F.count_if(throttled & (F.col("cause") == "key_range")).alias("key_range"),
        F.count_if(throttled).alias("throttled"),
    )


def round_stability(rounds: DataFrame) -> DataFrame:
    """Spread of the throttle rate over the rounds of each run."""
    rate = F.col("throttle_rate")
    return rounds.groupBy("run_id").agg(
        rows().alias("rounds"), F.round(F.avg(rate), 4).alias("mean_rate"),
        F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"),
        F.count_if(rate == 0).alias("zero_rounds"),
    )


def relative_bars(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``width``: the value as a percentage of the largest in its group; 0 if that is 0.

    The maxima are aggregated and joined back, so a large group is not gathered
    for a window.
    """
    tops = df.groupBy(*by).agg(F.max(value).alias("_top"))
    width = F.coalesce(F.col(value) / F.nullif(F.col("_top"), F.lit(0)) * 100, F.lit(0.0))
    return df.join(tops, list(by)).withColumn("width", F.round(width, 6)).drop("_top")


def category_counts(skus: DataFrame) -> DataFrame:
    """Number of SKUs per origin or category code."""
    code = F.regexp_extract("item_id", "^ITEM#([^-]+)-", 1)
    return skus.groupBy(code.alias("category")).agg(rows().alias("sku_count"))


def key_check(df: DataFrame, keys: Sequence[str], expected_rows: int | None = None) -> DataFrame:
    """Row count, distinct keys and keys that repeat, after one shuffle of pre-counted keys."""
    per_key = df.groupBy(*keys).agg(rows().alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    repeated = F.count_if(F.col("n") > 1)
    ok = repeated == 0
    if expected_rows is not None:
        ok = ok & (total == expected_rows)
    return per_key.agg(
        total.alias("row_count"), rows().alias("distinct_keys"),
        repeated.alias("repeated_keys"), ok.alias("ok"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("copies")).filter(F.col("copies") > 1)


def assert_keys(df: DataFrame, keys: Sequence[str], expected_rows: int | None = None) -> None:
    found = key_check(df, keys, expected_rows).first()
    if not found["ok"]:
        raise ValueError(f"key check failed: {found.asDict()}")


def warehouse_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("warehouse_id").agg(
        rows().alias("total_items"), F.sum("quantity").alias("total_quantity")
    )


def stock_kpis(stock: DataFrame, movements: DataFrame) -> DataFrame:
    """Stock value, pieces shipped and turnover per warehouse and category, with totals.

    Both inputs shrink to (warehouse, category) before they meet.
    """
    keys = ["warehouse_id", "category"]
    code = F.regexp_extract("item_id", "^ITEM#([^-]+)-", 1).alias("category")
    held = stock.groupBy("warehouse_id", code).agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("value"), F.sum("quantity").alias("pieces"),
        F.lit(0).cast("bigint").alias("shipped"), F.lit(0).cast("bigint").alias("net"),
    )
    moved = movements.groupBy("warehouse_id", code).agg(
        F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("pieces"),
        F.sum(F.when(F.col("type") == "ship", -F.col("signed_quantity")).otherwise(0)).alias("shipped"),
        F.sum("signed_quantity").alias("net"),
    )
    totals = held.unionByName(moved).cube(*keys).agg(
        *[F.sum(c).alias(c) for c in ("value", "pieces", "shipped", "net")]
    )
    # Opening stock is today's stock minus the net movement; turnover uses the mean of both ends.
    mean_stock = F.col("pieces") - F.col("net") / 2
    return totals.select(
        *[F.coalesce(k, F.lit("ALL")).alias(k) for k in keys],
        F.col("value").alias("stock_value"), F.col("pieces").alias("stock_pieces"), "shipped",
        F.coalesce(F.round(F.col("shipped") / F.nullif(mean_stock, F.lit(0.0)), 6), F.lit(0.0))
        .alias("turnover"),
    )
