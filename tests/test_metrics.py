import math
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from depotlens.functions.percentiles import floor_index, nearest_rank, profile
from depotlens.functions.scalar import fixed1, percent, percent_fixed1, percent_whole, round_half_up
from depotlens.operators import metrics, runs
from depotlens.operators.validation import classify


def test_both_percentiles_for_many_sizes(spark):
    rows = [(n, (i * 7919) % 101) for n in range(1, 131) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, latency_ms long")
    got = profile(df, "latency_ms", ["g"]).select(
        "g", *[nearest_rank(p).alias(f"n{p}") for p in (50, 95, 99)],
        *[floor_index(p).alias(f"f{p}") for p in (50, 95, 99)],
    ).collect()
    assert len(got) == 130
    for row in got:
        n = row["g"]
        values = sorted((i * 7919) % 101 for i in range(n))
        for p in (50, 95, 99):
            assert row[f"n{p}"] == values[max(0, math.ceil(p / 100 * n) - 1)]
            assert row[f"f{p}"] == values[min(int(n * p / 100.0), n - 1)]


@pytest.mark.parametrize("values,want", [
    ([], (0, 0)), ([5], (5, 5)), (range(1, 21), (19, 20)), (range(100), (94, 95)), ([None, 3], (3, 3)),
    ([0.5], (0.5, 0.5)), ([1.2, 1.9, 1.4], (1.9, 1.9)),
])
def test_small_groups(spark, values, want):
    kind = "double" if any(isinstance(v, float) for v in values) else "long"
    df = spark.createDataFrame([(v,) for v in values], f"latency_ms {kind}")
    row = profile(df.withColumn("g", F.lit(1)), "latency_ms", []).select(
        nearest_rank(95).alias("n"), floor_index(95).alias("f")
    ).first()
    assert tuple(row or (0, 0)) == want


def test_one_decimal_text_follows_the_binary_value(spark):
    pairs = [(n, t) for t in range(1, 121) for n in range(t + 1)]
    df = spark.createDataFrame(pairs, "n long, t long")
    for row in df.select("n", "t", percent_fixed1(F.col("n"), F.col("t")).alias("s")).collect():
        exact = Decimal(row["n"] / row["t"] * 100)
        assert row["s"] == str(exact.quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)), (row["n"], row["t"])
    odd = spark.createDataFrame([(1.45,), (0.25,), (1.55,), (8.345,), (0.05,), (99.95,)], "x double")
    for row in odd.select("x", fixed1(F.col("x")).alias("s")).collect():
        assert row["s"] == str(Decimal(row["x"]).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def test_rounding_and_empty_totals(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"))).collect()] == [-2, 3, 0]
    zero = spark.range(1).select(
        percent(F.lit(0), F.lit(0)), percent_fixed1(F.lit(0), F.lit(0)), percent_whole(F.lit(0), F.lit(0)))
    assert tuple(zero.first()) == (0.0, "0.0", 0)


def log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, variant string, round int, second int, latency_ms long, error_name string, ts timestamp")


def test_rules_differ(spark):
    names = ["ProvisionedThroughputExceededException", "ThrottlingException", "RequestLimitExceeded",
             "ConditionalCheckFailedException", "Other", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, error_name string")
    got = {r: [x["status"] for x in classify(df, r).orderBy("i").collect()] for r in ("load", "impact", "script")}
    assert got["load"] == ["throttled"] * 3 + ["success"] * 3
    assert got["impact"] == ["throttled"] * 2 + ["error", "success", "error", "success"]
    assert got["script"] == ["throttled", None, None, None, None, "success"]


def test_report_counts_and_uncounted_latencies(spark):
    rows = [(i, None) for i in range(1, 81)] + [(i, "ProvisionedThroughputExceededException") for i in range(81, 101)]
    rows += [(1000, "Other")] * 100
    df = spark.createDataFrame(rows, "latency_ms long, error_name string").withColumn("g", F.lit(1))
    row = metrics.load_report(classify(df, "script"), ["g"]).first()
    assert (row["total"], row["success_rate"], row["throttle_rate"]) == (100, "80.0", "20.0")
    assert row["p50_ms"] == 1000 and row["note"] is None
    nothing = metrics.load_report(classify(df.filter("error_name = 'Other'"), "script"), ["g"]).first()
    assert nothing["note"] == "No requests were completed." and nothing["success_rate"] == "0.0"


def test_summaries_add_up_and_runs_are_not_means_of_rounds(spark):
    t = datetime(2026, 1, 1)
    rows = [("r", "bad", 0, 0, 10, None, t)] * 3 + [("r", "bad", 1, 1, 90, "ThrottlingException", t)]
    df = classify(log(spark, rows), "impact")
    run = metrics.run_summary(df).first()
    assert (run["avg_latency_ms"], run["iterations"], run["throttle_count"]) == (30, 2, 1)
    assert (run["success_avg_latency_ms"], run["throttled_avg_latency_ms"]) == (10, 90)
    rolled = {(r["round"], r["is_run"]): r for r in metrics.impact_rollup(df).collect()}
    assert rolled[(None, True)]["throttle_rate"] == 25.0 and rolled[(1, False)]["throttle_rate"] == 100.0
    assert all(
        r["success_count"] + r["throttle_count"] + r["error_count"] == r["total_requests"] for r in rolled.values())
    stable = metrics.round_stability(metrics.round_summary(df)).first()
    assert (stable["rounds"], stable["zero_rounds"], stable["mean_rate"]) == (2, 1, 50.0)


def test_overflow_of_one_hot_key(spark):
    # 4,034 requests in a second, 80 % on one key, limit 1,000 per key and second.
    rows = [("WH-TOKYO", 3227), ("WH-OSAKA", 403), ("WH-FUKUOKA", 404)]
    df = spark.createDataFrame(rows, "warehouse_id string, n int").selectExpr(
        "warehouse_id", "explode(sequence(1, n))", "timestamp'2026-01-01 00:00:00' AS ts")
    row = metrics.overflow(df, "warehouse_id", 1000).first()
    assert (row["demand"], row["served"], row["rejected"], row["rejected_percent"]) == (4034, 1807, 2227, 55.2)


def test_distribution_keeps_unseen_targets(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 3, "k string")
    got = {r["k"]: r for r in metrics.distribution_check(df, "k", {"a": 0.7, "b": 0.2, "c": 0.1}, 0.05).collect()}
    assert (got["a"]["share"], got["a"]["within_tolerance"]) == (0.7, True)
    assert got["b"]["within_tolerance"] is False and got["c"]["requests"] == 0


def test_bars_of_an_all_zero_group(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 5), ("b", 10)], "g string, x long")
    got = sorted((r["g"], r["width"]) for r in metrics.relative_bars(df, "x", ["g"]).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", 50.0), ("b", 100.0)]


def test_key_check(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "a int, b int")
    got = metrics.key_check(df, ["a", "b"]).first()
    assert (got["row_count"], got["distinct_keys"], got["repeated_keys"], got["ok"]) == (3, 2, 1, False)
    metrics.assert_keys(df.distinct(), ["a", "b"], 2)
    with pytest.raises(ValueError):
        metrics.assert_keys(df.distinct(), ["a", "b"], 3)


# The published run records (variant, seconds, total, success, throttled).
PUBLISHED = [
    ("efce4e5a", "bad", 119, 53640, 53640, 0, 451), ("19f5d9e7", "bad", 119, 480000, 216860, 263140, 4034),
    ("b8ebd972", "good", 119, 480000, 480000, 0, 4034), ("dd4e98a0", "goodGsi", 119, 480000, 352340, 127660, 4034),
    ("de579e29", "badOnDemand", 119, 480000, 215851, 264149, 4034), ("b5854f91", "bad", 119, 480000, 214764, 265236, 4034),
    ("a9be692b", "bad", 120, 480000, 215100, 264900, 4000), ("5877167c", "badOnDemand", 119, 480000, 335874, 144126, 4034),
    ("781bdaa1", "bad", 119, 480000, 216059, 263941, 4034), ("7ac0fb12", "badOnDemand", 119, 480000, 480000, 0, 4034),
]


@pytest.fixture()
def published(spark):
    start = datetime(2026, 8, 1)
    run_rows = [(e, v, start, "RUNNING", 27, 4000) for e, v, *_ in PUBLISHED]
    runs_df = spark.createDataFrame(
        run_rows, "execution_id string, variant string, started_at timestamp, status string, worker_count int, declared_rps int")
    deltas = []
    for e, _, seconds, total, ok, throttled, _ in PUBLISHED:
        end = datetime.fromtimestamp(start.timestamp() + seconds)
        for w in range(27):
            first = w == 0
            deltas.append((e, w, end, total if first else 0, ok if first else 0, throttled if first else 0, 1))
    deltas_df = spark.createDataFrame(
        deltas, "execution_id string, worker long, until timestamp, d_total long, d_success long, d_throttle long, completed_workers int")
    return runs_df, deltas_df


def test_published_runs(published):
    runs_df, deltas = published
    progress = runs.run_progress(runs_df, deltas)
    got = {r["execution_id"]: r for r in runs.effective_rps(progress).collect()}
    assert {e: got[e]["effective_rps"] for e, *_ in PUBLISHED} == {p[0]: p[-1] for p in PUBLISHED}
    assert {r["status"] for r in progress.collect()} == {"COMPLETED"}
    summary = {r["variant"]: r for r in runs.variant_summary(progress.filter("execution_id <> 'efce4e5a'")).collect()}
    assert summary["good"]["error_rate"] == "0.0" and summary["goodGsi"]["error_rate"] == "26.6"
    assert summary["bad"]["error_rate"] == "55.1" and summary["bad"]["avg_duration"] == "119"


def test_progress_of_unfinished_and_silent_runs(published):
    runs_df, deltas = published
    partial = deltas.filter("worker < 26 OR execution_id <> '19f5d9e7'").filter("execution_id <> 'b8ebd972'")
    got = {r["execution_id"]: r for r in runs.run_progress(runs_df, partial).collect()}
    assert got["19f5d9e7"]["status"] == "RUNNING" and got["19f5d9e7"]["completed_workers"] == 26
    assert (got["b8ebd972"]["status"], got["b8ebd972"]["total_requests"], got["b8ebd972"]["elapsed_seconds"]) == (
        "RUNNING", 0, 0)


def test_deltas_add_up_to_the_log(spark, sf):
    from depotlens.sources.tables import requests

    log_df = requests(spark, sf)
    sums = runs.progress_deltas(log_df).agg(F.sum("d_total"), F.sum("d_success"), F.sum("d_throttle")).first()
    assert sums[0] == log_df.count() == sums[1] + sums[2]


def test_fractional_percentiles_by_ranges(spark):
    from depotlens.operators.metrics import floor_index_percentiles, nearest_rank_percentiles

    rows = [(g, ((i * 7919) % 101) / 8) for g in range(1, 40) for i in range(g)] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, value double")
    floor = {r["g"]: r for r in floor_index_percentiles(df, ["g"], "value").collect()}
    nearest = {r["g"]: r for r in nearest_rank_percentiles(df, ["g"], "value").collect()}
    assert floor[0]["p50"] == nearest[0]["p99"] == 0
    for g in range(1, 40):
        values = sorted(v for k, v in rows if k == g)
        for p in (50, 95, 99):
            assert floor[g][f"p{p}"] == values[min(g * p // 100, g - 1)]
            assert nearest[g][f"p{p}"] == values[(g * p + 99) // 100 - 1]
    one = spark.createDataFrame([(1, 0.5)], "g int, value double")
    assert floor_index_percentiles(one, ["g"], "value").first()["p50"] == 0.5


def test_totals_of_keys_read_the_log_once(spark, tmp_path):
    from depotlens.operators.metrics import distribution_check, hot_keys

    spark.createDataFrame([(i, f"k{i % 3}") for i in range(30)], "id int, k string").write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    for df in (hot_keys(log, "k", 2), distribution_check(log, "k", {"k0": 0.3}, 0.1)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") >= 1 or plan.count("FileScan parquet") == 1
