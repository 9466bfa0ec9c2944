"""Request-log roll-ups, runs, windows, skew reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.functions import sketches
from depotlens.operators import metrics, runs, skew
from depotlens.operators.validation import classify
from depotlens.plans.registry import query
from depotlens.sources import tables
from depotlens.sources.tables import inventory, movements, requests

COUNTS = """count(*) AS total_requests, count(*) FILTER (status = 'success') AS success_count,
    count(*) FILTER (status = 'throttled') AS throttle_count,
    count(*) FILTER (status = 'error') AS error_count"""
MEAN = "coalesce(floor(avg(latency_ms){} + 0.5), 0)::BIGINT"
NEAREST = ", ".join(
    f"coalesce(quantile_disc(latency_ms, {p / 100}), 0)::BIGINT AS p{p}_latency_ms" for p in (50, 95, 99)
)
LATENCIES = f"{MEAN.format('')} AS avg_latency_ms, {NEAREST}"
BY_STATUS = f"""{MEAN.format(" FILTER (status = 'success')")} AS success_avg_latency_ms,
    {MEAN.format(" FILTER (status = 'throttled')")} AS throttled_avg_latency_ms"""


def rate_sql(n: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN floor({n}::DOUBLE / {total} * 1000 + 0.5) / 10 ELSE 0.0 END"


def fixed1_sql(n: str, total: str) -> str:
    """One-decimal text judged on the exact binary value of the percentage."""
    x = f"({n}::DOUBLE / {total} * 100)"
    c, high = f"floor({x} * 10 + 0.5)", f"(floor({x} * 1048576) / 1048576)"
    tenths = f"({c} - CASE WHEN {high} * 20 - ({c} * 2 - 1) < ({x} - {high}) * -20 THEN 1 ELSE 0 END)"
    return f"""CASE WHEN {total} > 0 THEN floor({tenths} / 10)::BIGINT::VARCHAR || '.'
        || ({tenths}::BIGINT % 10)::VARCHAR ELSE '0.0' END"""


@query("agg_1_status_counts", f"SELECT variant, {COUNTS} FROM requests GROUP BY variant", "requests")
def _(spark, sf):
    return metrics.status_counts(requests(spark, sf), ["variant"])


@query("agg_2_mean_latency", f"""
    SELECT run_id, {MEAN.format('')} AS avg_latency_ms, {BY_STATUS} FROM requests GROUP BY run_id""", "requests")
def _(spark, sf):
    return metrics.mean_latency(requests(spark, sf), ["run_id"])


@query("agg_3_nearest_rank", """
    SELECT run_id, quantile_disc(latency_ms, 0.5)::BIGINT AS p50, quantile_disc(latency_ms, 0.95)::BIGINT AS p95,
      quantile_disc(latency_ms, 0.99)::BIGINT AS p99 FROM requests GROUP BY run_id""", "requests")
def _(spark, sf):
    return metrics.nearest_rank_percentiles(requests(spark, sf), ["run_id"])


def floor_index_sql(by: str, columns: str = "") -> str:
    return f"""SELECT {by}, {columns}
      max(latency_ms) FILTER (rn = least(n * 50 // 100, n - 1) + 1) AS p50,
      max(latency_ms) FILTER (rn = least(n * 95 // 100, n - 1) + 1) AS p95,
      max(latency_ms) FILTER (rn = least(n * 99 // 100, n - 1) + 1) AS p99
    FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY latency_ms) AS rn,
          count(*) OVER (PARTITION BY {by}) AS n FROM requests) ranked GROUP BY {by}"""


@query("agg_4_floor_index", floor_index_sql("run_id"), "requests")
def _(spark, sf):
    return metrics.floor_index_percentiles(requests(spark, sf), ["run_id"])


@query("win_4_floor_index_per_variant", floor_index_sql("variant"), "requests")
def _(spark, sf):
    return metrics.floor_index_percentiles(requests(spark, sf), ["variant"])


def fractional_sql(by: str, rule: str) -> str:
    return f"""SELECT {by},
      max(value) FILTER (rn = {rule.format(p=50)} + 1) AS p50, max(value) FILTER (rn = {rule.format(p=95)} + 1) AS p95,
      max(value) FILTER (rn = {rule.format(p=99)} + 1) AS p99
    FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY value) AS rn,
          count(*) OVER (PARTITION BY {by}) AS n FROM events) ranked GROUP BY {by}"""


@query("agg_4_fractional_values", fractional_sql("user_id", "least(n * {p} // 100, n - 1)"))
def _(spark, sf):
    return metrics.floor_index_percentiles(tables.load(spark, sf, "events"), ["user_id"], "value")


@query("win_4_fractional_per_type", fractional_sql("event_type", "least(n * {p} // 100, n - 1)"))
def _(spark, sf):
    return metrics.floor_index_percentiles(tables.load(spark, sf, "events"), ["event_type"], "value")


@query("agg_4_sketched_percentiles", fractional_sql("event_type", "least(n * {p} // 100, n - 1)"))
def _(spark, sf):
    """The same values, ranked only between the bounds that a sketch a group gives."""
    return sketches.narrowed_percentiles(tables.load(spark, sf, "events"), "value", ["event_type"], [50, 95, 99])


@query("agg_3_fractional_values", fractional_sql("event_type", "((n * {p} + 99) // 100 - 1)"))
def _(spark, sf):
    return metrics.nearest_rank_percentiles(tables.load(spark, sf, "events"), ["event_type"], "value")


@query("agg_5_rates", f"""
    SELECT run_id, {rate_sql('t', 'n')} AS throttle_rate, {fixed1_sql('t', 'n')} AS throttle_rate_text,
      {fixed1_sql('s', 'n')} AS success_rate_text, floor(s::DOUBLE / n * 100 + 0.5)::BIGINT AS success_percent,
      floor(t::DOUBLE / n * 100 + 0.5)::BIGINT AS throttle_percent
    FROM (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'success') AS s,
          count(*) FILTER (status = 'throttled') AS t FROM requests GROUP BY run_id) c""", "requests")
def _(spark, sf):
    return metrics.rates(requests(spark, sf), ["run_id"])


_ROUNDS = f"""SELECT run_id, round, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started_at, {COUNTS},
    {LATENCIES}, {rate_sql("count(*) FILTER (status = 'throttled')", "count(*)")} AS throttle_rate
    FROM requests GROUP BY run_id, round"""


@query("agg_6_round_summary", _ROUNDS, "requests")
def _(spark, sf):
    return metrics.round_summary(requests(spark, sf))


@query("agg_7_run_summary", f"""
    SELECT run_id, variant, count(DISTINCT round) AS iterations, {COUNTS}, {LATENCIES}, {BY_STATUS}
    FROM requests GROUP BY run_id, variant""", "requests")
def _(spark, sf):
    return metrics.run_summary(requests(spark, sf))


@query("agg_8_rounds_and_run", f"""
    SELECT run_id, round, grouping(round) = 1 AS is_run, {COUNTS}, {LATENCIES},
      {rate_sql("count(*) FILTER (status = 'throttled')", "count(*)")} AS throttle_rate
    FROM requests GROUP BY GROUPING SETS ((run_id, round), (run_id))""", "requests")
def _(spark, sf):
    return metrics.impact_rollup(requests(spark, sf))


@query("agg_9_second_breakdown", """
    SELECT variant, second, count(*) FILTER (status = 'success') AS success,
      count(*) FILTER (status = 'throttled') AS throttled, count(*) FILTER (status = 'error') AS error,
      (second + 1) || 's' AS label FROM requests GROUP BY variant, second""", "requests")
def _(spark, sf):
    return metrics.second_breakdown(requests(spark, sf), ["variant"])


DELTAS = """deltas AS (
    SELECT p.*, CASE WHEN until = max(until) OVER (PARTITION BY execution_id, worker) THEN 1 ELSE 0 END
      AS completed_workers
    FROM (SELECT run_id AS execution_id, worker,
        time_bucket(INTERVAL 5 SECOND, ts) + INTERVAL 5 SECOND AS until, count(*) AS d_total,
        count(*) FILTER (status <> 'throttled') AS d_success,
        count(*) FILTER (status = 'throttled') AS d_throttle
      FROM requests GROUP BY ALL) p)"""
PROGRESS = f"""{DELTAS}, progress AS (
    SELECT r.execution_id, r.variant, r.started_at,
      CASE WHEN coalesce(done, 0) >= r.worker_count THEN 'COMPLETED' ELSE r.status END AS status,
      coalesce(total, 0) AS total_requests, coalesce(success, 0) AS success_count,
      coalesce(throttle, 0) AS throttle_count,
      coalesce(date_diff('second', r.started_at, until), 0) AS elapsed_seconds,
      coalesce(done, 0) AS completed_workers, r.declared_rps
    FROM runs r LEFT JOIN (SELECT execution_id, sum(d_total)::BIGINT AS total, sum(d_success)::BIGINT AS success,
        sum(d_throttle)::BIGINT AS throttle, max(until) AS until, sum(completed_workers)::BIGINT AS done
      FROM deltas GROUP BY execution_id) d USING (execution_id))"""


def progress(spark, sf):
    return runs.run_progress(tables.runs(spark, sf), runs.progress_deltas(requests(spark, sf)))


@query("str_4_progress_deltas", f"""WITH {DELTAS}
    SELECT execution_id, worker, strftime(until, '%Y-%m-%d %H:%M:%S') AS until, d_total, d_success, d_throttle,
      completed_workers FROM deltas""", "requests")
def _(spark, sf):
    deltas = runs.progress_deltas(requests(spark, sf))
    return deltas.withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


@query("agg_10_run_progress", f"""WITH {PROGRESS}
    SELECT execution_id, variant, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, status, total_requests,
      success_count, throttle_count, elapsed_seconds, completed_workers, declared_rps FROM progress""", "runs")
def _(spark, sf):
    return progress(spark, sf).withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))


@query("agg_11_variant_summary", f"""WITH {PROGRESS}
    SELECT *, {fixed1_sql('success_count', 'total_requests')} AS success_rate,
      {fixed1_sql('throttle_count', 'total_requests')} AS error_rate
    FROM (SELECT variant, sum(total_requests)::BIGINT AS total_requests, sum(success_count)::BIGINT AS success_count,
        sum(throttle_count)::BIGINT AS throttle_count,
        floor(avg(elapsed_seconds) + 0.5)::BIGINT::VARCHAR AS avg_duration
      FROM progress GROUP BY variant) s""", "runs")
def _(spark, sf):
    return runs.variant_summary(progress(spark, sf))


@query("agg_12_latest_run", f"""WITH {PROGRESS}
    SELECT variant, execution_id, status, total_requests, success_count, throttle_count, elapsed_seconds,
      completed_workers, declared_rps, strftime(started_at, '%Y-%m-%d') AS started_at
    FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY started_at DESC, execution_id DESC) AS rn
      FROM progress) r WHERE rn = 1""", "runs")
def _(spark, sf):
    return runs.latest_per_variant(progress(spark, sf)).withColumn(
        "started_at", F.date_format("started_at", "yyyy-MM-dd")
    )


@query("agg_13_category_counts", """
    SELECT regexp_extract(item_id, '^ITEM#([^-]+)-', 1) AS category, count(*) AS sku_count FROM skus
    GROUP BY ALL""", "skus")
def _(spark, sf):
    return metrics.category_counts(tables.skus(spark, sf))


@query("agg_14_key_check", """
    SELECT 'inventory' AS checked, sum(n)::BIGINT AS row_count, count(*) AS distinct_keys,
      count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (n > 1) = 0 AS ok
    FROM (SELECT item_id, warehouse_id, count(*) AS n FROM inventory GROUP BY ALL) k
    UNION ALL
    SELECT 'lineitem', sum(n)::BIGINT, count(*), count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) k""", "inventory")
def _(spark, sf):
    good = metrics.key_check(inventory(spark, sf), ["item_id", "warehouse_id"])
    line = metrics.key_check(tables.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return good.withColumn("checked", F.lit("inventory")).unionByName(
        line.withColumn("checked", F.lit("lineitem"))
    )


@query("agg_14_sketched_key_check", """
    SELECT 'inventory' AS checked, sum(n)::BIGINT AS row_count, count(*) AS distinct_keys,
      count(*) FILTER (n > 1) AS repeated_keys, count(*) FILTER (n > 1) = 0 AS ok
    FROM (SELECT item_id, warehouse_id, count(*) AS n FROM inventory GROUP BY ALL) k
    UNION ALL
    SELECT 'events', sum(n)::BIGINT, count(*), count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) k""", "inventory")
def _(spark, sf):
    """Segments without a repeated key are settled by their sketches."""
    good = sketches.sketched_key_check(inventory(spark, sf), ["item_id", "warehouse_id"])
    bad = sketches.sketched_key_check(tables.load(spark, sf, "events"), ["user_id", "event_type"])
    return good.withColumn("checked", F.lit("inventory")).unionByName(bad.withColumn("checked", F.lit("events")))


@query("agg_14_repeated_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return metrics.repeated_keys(tables.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_SCRIPT = """requests2 AS (SELECT * REPLACE (CASE WHEN error_name IS NULL THEN 'success'
    WHEN error_name = 'ProvisionedThroughputExceededException' THEN 'throttled' END AS status) FROM requests)"""


@query("agg_15_load_report", f"""WITH {_SCRIPT}, pct AS (
      {floor_index_sql('variant', '''count(*) FILTER (status = 'success') AS success,
        count(*) FILTER (status = 'throttled') AS throttle,''').replace('FROM requests)', 'FROM requests2)')})
    SELECT variant, success + throttle AS total, success, throttle,
      {fixed1_sql('success', '(success + throttle)')} AS success_rate,
      {fixed1_sql('throttle', '(success + throttle)')} AS throttle_rate,
      p50 AS p50_ms, p95 AS p95_ms, p99 AS p99_ms,
      CASE WHEN success + throttle = 0 THEN 'No requests were completed.' END AS note FROM pct""", "requests")
def _(spark, sf):
    return metrics.load_report(classify(requests(spark, sf), "script"), ["variant"])


@query("agg_16_effective_rps", f"""WITH {PROGRESS}
    SELECT execution_id, variant, total_requests, elapsed_seconds,
      floor(total_requests::DOUBLE / elapsed_seconds + 0.5)::BIGINT AS effective_rps,
      round(total_requests::DOUBLE / elapsed_seconds / declared_rps, 6) AS declared_share
    FROM progress""", "runs")
def _(spark, sf):
    return runs.effective_rps(progress(spark, sf))


@query("agg_17_hot_keys", """
    SELECT item_id, count(*) AS requests, round(count(*)::DOUBLE / (SELECT count(*) FROM requests), 6) AS share
    FROM requests GROUP BY item_id ORDER BY requests DESC, item_id LIMIT 10""", "requests")
def _(spark, sf):
    return metrics.hot_keys(requests(spark, sf), "item_id", 10)


@query("agg_18_distribution", """
    SELECT warehouse_id, requests, round(share, 6) AS share, target, abs(share - target) <= 0.05 AS within_tolerance
    FROM (SELECT warehouse_id, count(*) AS requests, count(*)::DOUBLE / (SELECT count(*) FROM requests) AS share,
        CASE warehouse_id WHEN 'WH-TOKYO' THEN 0.8::DOUBLE WHEN 'WH-OSAKA' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS target
      FROM requests GROUP BY warehouse_id) s""", "requests")
def _(spark, sf):
    targets = {"WH-TOKYO": 0.8, "WH-OSAKA": 0.15, "WH-FUKUOKA": 0.05}
    return metrics.distribution_check(requests(spark, sf), "warehouse_id", targets, 0.05)


@query("agg_19_overflow", f"""
    SELECT variant, demand, served, rejected, hot_units, {rate_sql('rejected', 'demand')} AS rejected_percent
    FROM (SELECT variant, sum(n)::BIGINT AS demand, sum(least(n, 2))::BIGINT AS served,
        sum(greatest(n - 2, 0))::BIGINT AS rejected, count(*) FILTER (n > 2) AS hot_units
      FROM (SELECT variant, warehouse_id, date_trunc('hour', ts) AS unit, count(*) AS n FROM requests GROUP BY ALL) u
      GROUP BY variant) s""", "requests")
def _(spark, sf):
    return metrics.overflow(requests(spark, sf), "warehouse_id", 2, "hour", ["variant"])


@query("agg_20_throttle_causes", """
    SELECT variant, target, count(*) FILTER (status = 'throttled' AND cause = 'capacity') AS capacity,
      count(*) FILTER (status = 'throttled' AND cause = 'key_range') AS key_range,
      count(*) FILTER (status = 'throttled') AS throttled FROM requests GROUP BY variant, target""", "requests")
def _(spark, sf):
    return metrics.throttle_causes(requests(spark, sf))


@query("agg_21_round_stability", f"""
    SELECT run_id, count(*) AS rounds, round(avg(throttle_rate), 4) AS mean_rate, min(throttle_rate) AS min_rate,
      max(throttle_rate) AS max_rate, count(*) FILTER (throttle_rate = 0) AS zero_rounds
    FROM ({_ROUNDS}) r GROUP BY run_id""", "requests")
def _(spark, sf):
    return metrics.round_stability(metrics.round_summary(requests(spark, sf)))


@query("agg_22_warehouse_totals", """
    SELECT warehouse_id, count(*) AS total_items, sum(quantity)::BIGINT AS total_quantity FROM inventory
    GROUP BY warehouse_id""", "inventory")
def _(spark, sf):
    return metrics.warehouse_totals(inventory(spark, sf))


@query("agg_23_stock_kpis", """
    SELECT coalesce(warehouse_id, 'ALL') AS warehouse_id, coalesce(category, 'ALL') AS category,
      sum(value)::BIGINT AS stock_value, sum(pieces)::BIGINT AS stock_pieces, sum(shipped)::BIGINT AS shipped,
      coalesce(round(sum(shipped)::DOUBLE / nullif(sum(pieces)::DOUBLE - sum(net)::DOUBLE / 2, 0), 6), 0)
        AS turnover
    FROM (SELECT warehouse_id, regexp_extract(item_id, '^ITEM#([^-]+)-', 1) AS category,
        quantity * unit_price AS value, quantity AS pieces, 0 AS shipped, 0 AS net FROM inventory
      UNION ALL
      SELECT warehouse_id, regexp_extract(item_id, '^ITEM#([^-]+)-', 1), 0, 0,
        CASE WHEN type = 'ship' THEN -signed_quantity ELSE 0 END, signed_quantity FROM movements) u
    GROUP BY CUBE (warehouse_id, category)""", "inventory movements")
def _(spark, sf):
    return metrics.stock_kpis(inventory(spark, sf), movements(spark, sf))


@query("win_1_relative_bars", f"""
    SELECT run_id, round, avg_latency_ms, round(CASE WHEN top > 0 THEN avg_latency_ms::DOUBLE / top * 100 ELSE 0 END, 6)
      AS width
    FROM (SELECT run_id, round, avg_latency_ms, max(avg_latency_ms) OVER (PARTITION BY run_id) AS top
      FROM (SELECT run_id, round, {MEAN.format('')} AS avg_latency_ms FROM requests GROUP BY ALL) m) w""", "requests")
def _(spark, sf):
    means = metrics.mean_latency(requests(spark, sf), ["run_id", "round"])
    return metrics.relative_bars(means.select("run_id", "round", "avg_latency_ms"), "avg_latency_ms", ["run_id"])


@query("win_3_run_trend", f"""WITH {PROGRESS}, peaks AS (
      SELECT execution_id, round(max(served)::DOUBLE / 60, 6) AS peak FROM (
        SELECT run_id AS execution_id, date_trunc('minute', ts) AS m, count(*) AS served FROM requests
        WHERE status <> 'throttled' GROUP BY ALL) s GROUP BY execution_id)
    SELECT execution_id, variant, strftime(started_at, '%Y-%m-%d') AS started_at, throttle_rate, peak_per_second,
      lag(throttle_rate) OVER w AS previous_rate, lag(peak_per_second) OVER w AS previous_peak,
      round(throttle_rate - lag(throttle_rate) OVER w, 6) AS rate_change
    FROM (SELECT p.*, {rate_sql('throttle_count', 'total_requests')} AS throttle_rate,
        coalesce(peak, 0.0::DOUBLE) AS peak_per_second
      FROM progress p LEFT JOIN peaks USING (execution_id)) r
    WINDOW w AS (PARTITION BY variant ORDER BY started_at, execution_id)""", "runs")
def _(spark, sf):
    trend = runs.run_trend(progress(spark, sf), runs.peak_throughput(requests(spark, sf)))
    return trend.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd"))


@query("cls_1_outcomes", """
    SELECT coalesce(error_name, 'none') AS error_name,
      CASE WHEN error_name IN ('ProvisionedThroughputExceededException', 'ThrottlingException',
        'RequestLimitExceeded') THEN 'throttled' ELSE 'success' END AS by_load,
      status AS by_impact,
      CASE WHEN error_name IS NULL THEN 'success' WHEN error_name = 'ProvisionedThroughputExceededException'
        THEN 'throttled' ELSE 'uncounted' END AS by_script, count(*) AS requests
    FROM requests GROUP BY ALL""", "requests")
def _(spark, sf):
    judged = requests(spark, sf)
    for rules in ("load", "impact", "script"):
        judged = classify(judged, rules, into=f"by_{rules}")
    return judged.groupBy(
        F.coalesce("error_name", F.lit("none")).alias("error_name"), "by_load", "by_impact",
        F.coalesce("by_script", F.lit("uncounted")).alias("by_script"),
    ).agg(F.count(F.lit(1)).alias("requests"))


@query("skw_1_salted_totals", """
    SELECT warehouse_id, count(*) AS n, sum(latency_ms)::BIGINT AS total, count(DISTINCT request_id % 10) AS shards_used
    FROM requests GROUP BY warehouse_id""", "requests")
def _(spark, sf):
    return skew.salted_totals(requests(spark, sf), "warehouse_id", "request_id", "latency_ms", 10, "value")


@query("skw_2_hour_buckets", """
    SELECT warehouse_id || '#' || strftime(ts, '%Y-%m-%dT%H') AS bucket, count(*) AS requests,
      sum(latency_ms)::BIGINT AS latency_sum FROM requests GROUP BY ALL""", "requests")
def _(spark, sf):
    bucket = skew.time_bucket(F.col("warehouse_id"), F.col("ts")).alias("bucket")
    return requests(spark, sf).groupBy(bucket).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("latency_ms").alias("latency_sum")
    )


@query("skw_3_composite_key", """
    SELECT location || '#' || lpad(unit_price::VARCHAR, 6, '0') AS sort_key, warehouse_id, item_id
    FROM inventory WHERE starts_with(location || '#' || lpad(unit_price::VARCHAR, 6, '0'), 'A-01-01#0009')""",
    "inventory")
def _(spark, sf):
    key = skew.composite_key(F.col("location"), (F.col("unit_price"), 6))
    return inventory(spark, sf).select(key.alias("sort_key"), "warehouse_id", "item_id").filter(
        F.col("sort_key").startswith("A-01-01#0009")
    )


@query("skw_3_prefix_levels", """
    SELECT level, array_to_string(parts[1:level], '#') AS prefix, count(*) AS n, sum(quantity)::BIGINT AS total
    FROM (SELECT *, [warehouse_id, substr(location, 1, 1), location] AS parts FROM inventory) i,
      (SELECT unnest([1, 2, 3]) AS level) l GROUP BY ALL""", "inventory")
def _(spark, sf):
    keyed = inventory(spark, sf).withColumn("path", skew.composite_key(
        F.col("warehouse_id"), F.substring("location", 1, 1), F.col("location")
    ))
    return skew.prefix_levels(keyed, "path", "quantity")


@query("skw_4_segment_skew", """
    SELECT segment, coalesce(sum(n), 0)::BIGINT AS n_rows, count(n) AS n_keys
    FROM (SELECT unnest(range(27))::INTEGER AS segment) s LEFT JOIN
      (SELECT user_id % 27 AS seg, user_id, count(*) AS n FROM events GROUP BY ALL) k ON seg = segment
    GROUP BY segment""")
def _(spark, sf):
    return skew.segment_skew(tables.load(spark, sf, "events"), "user_id", 27, "value")


@query("skw_4_warehouse_segments", """
    SELECT segment, coalesce(sum(n), 0)::BIGINT AS n_rows, count(n) AS n_keys
    FROM (SELECT unnest(range(27))::INTEGER AS segment) s LEFT JOIN
      (SELECT ascii(substr(warehouse_id, 4, 1)) % 27 AS seg, warehouse_id, count(*) AS n FROM inventory
       GROUP BY ALL) k ON seg = segment
    GROUP BY segment""", "inventory")
def _(spark, sf):
    city = inventory(spark, sf).withColumn("city", F.substring("warehouse_id", 4, 20))
    return skew.segment_skew(city, "city", 27, "first_char")


@query("skw_4_load_overlap", """
    SELECT count(*) AS n_now, count(*) FILTER (l) AS n_last, count(*) FILTER (l) AS n_common, sum(n)::BIGINT AS n_rows
    FROM (SELECT user_id, count(*) AS n, bool_or(event_type <> 'view') AS l FROM events GROUP BY ALL) k""")
def _(spark, sf):
    """Users of all events against users of events other than views, from stored sketches of either; exact as long as
    no segment has more keys than a sketch holds."""
    log = tables.load(spark, sf, "events")
    now = sketches.segment_sketches(log, ["user_id"], 1024)
    last = sketches.segment_sketches(log.filter(F.col("event_type") != "view"), ["user_id"], 1024)
    totals = sketches.common_keys(now, last).agg(*[F.sum(c).alias(c) for c in ("n_now", "n_last", "n_common")])
    return totals.withColumn("n_rows", now.agg(F.sum("n_rows")).scalar())
