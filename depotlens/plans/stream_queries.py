"""Change feeds and live metrics, as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.plans.ledger_queries import SHIPPED
from depotlens.plans.registry import query
from depotlens.plans.source_queries import scratch
from depotlens.sources import tables
from depotlens.streaming import cdc, hot, live, ship

_LATEST = """SELECT *, row_number() OVER (PARTITION BY item_id, warehouse_id ORDER BY version DESC) AS rn FROM changes"""
_REPLICA = f"""SELECT item_id, warehouse_id, version, new_quantity FROM ({_LATEST}) r
    WHERE rn = 1 AND op = 'index'"""


@query("str_1_apply_changes", _REPLICA, "changes")
def _(spark, sf):
    feed = tables.changes(spark, sf)
    none = feed.filter(F.lit(False)).select(
        "item_id", "warehouse_id", "version", F.lit(False).alias("deleted"), "new_quantity"
    )
    return cdc.live_rows(cdc.apply_changes(none, feed))


@query("win_2_latest_version", f"""
    SELECT item_id, warehouse_id, version, op = 'delete' AS deleted, new_quantity FROM ({_LATEST}) r WHERE rn = 1""",
    "changes")
def _(spark, sf):
    return cdc.net_changes(tables.changes(spark, sf))


@query("str_2_bootstrap", f"""
    SELECT coalesce(s.item_id, c.item_id) AS item_id, coalesce(s.warehouse_id, c.warehouse_id) AS warehouse_id,
      coalesce(c.version, -1) AS version,
      CASE WHEN c.version IS NULL THEN s.quantity ELSE c.new_quantity END AS new_quantity
    FROM opening_stock s FULL OUTER JOIN (SELECT * FROM ({_LATEST}) r WHERE rn = 1) c
      ON s.item_id = c.item_id AND s.warehouse_id = c.warehouse_id
    WHERE coalesce(c.op, 'index') = 'index'""", "changes opening_stock")
def _(spark, sf):
    snapshot = tables.opening_stock(spark, sf).withColumnRenamed("quantity", "new_quantity")
    return cdc.live_rows(cdc.bootstrap(snapshot, tables.changes(spark, sf)))


@query("str_6_late_changes", """
    SELECT strftime(event_ts, '%Y-%m-%d') AS day, count(*) AS changes,
      count(*) FILTER (arrival_ts - event_ts > INTERVAL 24 HOUR) AS late FROM changes GROUP BY ALL""", "changes")
def _(spark, sf):
    return cdc.lateness_report(tables.changes(spark, sf))


@query("str_6_quarantine", """
    SELECT version, item_id FROM changes WHERE date_diff('hour', event_ts, arrival_ts) > 24""", "changes")
def _(spark, sf):
    return cdc.late_changes(tables.changes(spark, sf))[1].select("version", "item_id")


@query("str_7_sync_lag", """
    SELECT strftime(date_trunc('day', event_ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS changes,
      round(avg(lag), 6) AS avg_lag_seconds, max(lag) AS max_lag_seconds
    FROM (SELECT event_ts, date_diff('hour', event_ts, arrival_ts) * 3600 AS lag FROM changes) c GROUP BY ALL""",
    "changes")
def _(spark, sf):
    return cdc.sync_lag(tables.changes(spark, sf))


@query("str_8_running_totals", """
    SELECT warehouse_id,
      sum((new_quantity IS NOT NULL)::BIGINT - (old_quantity IS NOT NULL)::BIGINT)::BIGINT AS items,
      sum(coalesce(new_quantity, 0) - coalesce(old_quantity, 0))::BIGINT AS quantity
    FROM changes GROUP BY warehouse_id""", "changes")
def _(spark, sf):
    return cdc.running_totals(tables.changes(spark, sf))


_PER_SECOND = """
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS second_start,
      count(*) FILTER (status IN ('success', 'throttled')) AS rps, count(*) FILTER (status = 'success') AS success,
      count(*) FILTER (status = 'throttled') AS throttle,
      max(latency_ms) FILTER (rn = least(n * 50 // 100, n - 1) + 1) AS p50_ms,
      max(latency_ms) FILTER (rn = least(n * 95 // 100, n - 1) + 1) AS p95_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY latency_ms) AS rn,
        count(*) OVER (PARTITION BY s) AS n
      FROM (SELECT *, date_trunc('{unit}', ts) AS s FROM requests) t) ranked GROUP BY s"""


@query("str_3_per_second", _PER_SECOND.format(unit="second"), "requests")
def _(spark, sf):
    return live.per_second(tables.requests(spark, sf))


@query("str_3_per_hour", _PER_SECOND.format(unit="hour"), "requests")
def _(spark, sf):
    return live.per_second(tables.requests(spark, sf), width="1 hour")


@query("str_4_interval_deltas", """
    SELECT run_id, strftime(time_bucket(INTERVAL 5 SECOND, ts) + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS until,
      count(*) AS d_total, count(*) FILTER (status <> 'throttled') AS d_success,
      count(*) FILTER (status = 'throttled') AS d_throttle FROM requests GROUP BY ALL""", "requests")
def _(spark, sf):
    return live.interval_deltas(tables.requests(spark, sf))


@query("str_5_per_minute", """
    SELECT variant, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute_start,
      round(count(*) FILTER (status = 'success')::DOUBLE / 60, 6) AS consumed_per_second,
      round(count(*) FILTER (status = 'throttled')::DOUBLE / 60, 6) AS throttled_per_second,
      round(avg(latency_ms), 6) AS avg_latency_ms FROM requests GROUP BY ALL""", "requests")
def _(spark, sf):
    return live.per_minute(tables.requests(spark, sf))


def _stream_into(out: str, checkpoint: str, stream) -> None:
    """Runs a stream over all files there are."""

    def write(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()


@query("str_6_stream_retention", """
    SELECT version, item_id, warehouse_id, date_diff('hour', event_ts, arrival_ts) > 24 AS late FROM changes""", "changes")
def _(spark, sf):
    """Both sides of the retention bound, from two streams over the feed."""
    feed = tables.changes(spark, sf, tables.load_stream(spark, sf, "events"))
    path = scratch(spark, "retention")
    for running in cdc.start_retention(feed, path, scratch(spark, "retention-checkpoint")):
        running.awaitTermination()
    sides = [spark.read.schema(feed.schema).parquet(f"{path}/{side}").select(
        "version", "item_id", "warehouse_id", F.lit(late).alias("late")) for side, late in (("in_time", False), ("quarantine", True))]
    return sides[0].unionByName(sides[1])


@query("str_1_stream_replica", _REPLICA, "changes")
def _(spark, sf):
    feed = tables.changes(spark, sf, tables.load_stream(spark, sf, "events"))
    path = scratch(spark, "replica")
    cdc.start_replication(feed, path, scratch(spark, "replica-checkpoint"), horizon="24 hours").awaitTermination()
    return cdc.live_rows(cdc.read_replica(spark, path))


@query("str_3_stream_per_hour", _PER_SECOND.format(unit="hour"), "requests")
def _(spark, sf):
    """Counts of every micro-batch, merged on read: files may come in any order."""
    log = tables.requests(spark, sf, tables.load_stream(spark, sf, "events"))
    path = scratch(spark, "per-hour")
    live.start_counts(log, path, scratch(spark, "per-hour-checkpoint"), "1 hour").awaitTermination()
    return live.read_per_second(spark, path)


@query("str_3_stream_fractional", """
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start,
      max(value) FILTER (rn = least(n * 50 // 100, n - 1) + 1) AS p50,
      max(value) FILTER (rn = least(n * 95 // 100, n - 1) + 1) AS p95
    FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY value) AS rn, count(*) OVER (PARTITION BY h) AS n
      FROM (SELECT date_trunc('day', ts) AS h, value FROM events) t) ranked GROUP BY h""")
def _(spark, sf):
    """Values are fractional: sketches of every micro-batch are merged and say which of them to rank."""
    path = scratch(spark, "fractional")
    live.start_sketches(
        tables.load_stream(spark, sf, "events"), "value", path, scratch(spark, "fractional-checkpoint"), "1 day"
    ).awaitTermination()
    return live.read_window_percentiles(spark, path, [50, 95])


@query("agg_17_stream_hot_keys", """
    SELECT item_id, count(*) AS requests, round(count(*)::DOUBLE / (SELECT count(*) FROM requests), 6) AS share
    FROM requests GROUP BY item_id ORDER BY requests DESC, item_id LIMIT 10""", "requests")
def _(spark, sf):
    log, path = tables.requests(spark, sf, tables.load_stream(spark, sf, "events")), scratch(spark, "hot-keys")
    hot.start_key_counts(log, "item_id", path, scratch(spark, "hot-keys-checkpoint")).awaitTermination()
    return hot.read_hot_keys(spark, path, "item_id", 10)


@query("str_8_stream_running_totals", """
    SELECT warehouse_id,
      sum((new_quantity IS NOT NULL)::BIGINT - (old_quantity IS NOT NULL)::BIGINT)::BIGINT AS items,
      sum(coalesce(new_quantity, 0) - coalesce(old_quantity, 0))::BIGINT AS quantity
    FROM changes GROUP BY warehouse_id""", "changes")
def _(spark, sf):
    feed = tables.changes(spark, sf, tables.load_stream(spark, sf, "events"))
    path = scratch(spark, "totals")
    cdc.start_totals(feed, path, scratch(spark, "totals-checkpoint"), horizon="24 hours").awaitTermination()
    return cdc.read_totals(spark, path)


_DECIDED = SHIPPED + """
    SELECT item_id, warehouse_id, request_id, quantity, accepted, stock_after FROM shipped"""


#: Requests wait this long for earlier ones; the given log is in order, a feed in files may be this far out of it.
DELAY = "6 hours"


@query("sta_2_ship_stream", _DECIDED, "ship_requests opening_stock")
def _(spark, sf):
    """Decisions by timers while the log is read; the last ``DELAY`` of it is decided when it has ended."""
    asked = tables.ship_requests(spark, sf, tables.load_stream(spark, sf, "events"))
    out, checkpoint = scratch(spark, "ship"), scratch(spark, "ship-checkpoint")
    with ship.timer_state(spark):
        _stream_into(out, checkpoint, ship.ship_stream(asked, tables.opening_stock(spark, sf), DELAY))
    last = ship.waiting_decisions(spark, checkpoint)
    return spark.read.schema(last.schema).parquet(out).drop("batch_id").unionByName(last).drop("late")


@query("sta_2_ship_micro_batches", _DECIDED, "ship_requests opening_stock")
def _(spark, sf):
    asked = tables.ship_requests(spark, sf, tables.load_stream(spark, sf, "events"))
    path, opening = scratch(spark, "shipping"), tables.opening_stock(spark, sf)
    ship.start_shipping(
        asked, opening, path, scratch(spark, "shipping-checkpoint"), delay=DELAY
    ).awaitTermination()
    ship.finish_shipping(spark, opening, path)
    return spark.read.parquet(f"{path}/decisions").drop("batch_id", "ts", "late")
