"""Validation, conditional decrement, counters, stock ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.operators import ledger, validation
from depotlens.plans.registry import query
from depotlens.session import written_table
from depotlens.sources import tables
from depotlens.sources.tables import inventory, movements


@query("val_1_ship_requests", """
    SELECT request_id, CASE WHEN message IS NOT NULL THEN 'INVALID_REQUEST' END AS code, message
    FROM (SELECT request_id, CASE
        WHEN coalesce(warehouse_id, '') = '' THEN 'warehouseId is required and must be a string'
        WHEN coalesce(item_id, '') = '' THEN 'itemId is required and must be a string'
        WHEN NOT (quantity > 0) THEN 'quantity is required and must be a positive number'
        WHEN variant NOT IN ('bad', 'good', 'goodGsi', 'badOnDemand')
          THEN 'table is required and must be "bad", "good", "goodGsi" or "badOnDemand"' END AS message
      FROM raw_ship_requests) v""", "raw_ship_requests")
def _(spark, sf):
    checked = validation.validate_ship(tables.raw_ship_requests(spark, sf))
    return checked.select("request_id", "code", "message")


@query("val_1_quarantine_counts", """
    SELECT message, count(*) AS requests FROM (SELECT CASE
        WHEN coalesce(warehouse_id, '') = '' THEN 'warehouseId is required and must be a string'
        WHEN coalesce(item_id, '') = '' THEN 'itemId is required and must be a string'
        WHEN NOT (quantity > 0) THEN 'quantity is required and must be a positive number'
        WHEN variant NOT IN ('bad', 'good', 'goodGsi', 'badOnDemand')
          THEN 'table is required and must be "bad", "good", "goodGsi" or "badOnDemand"' END AS message
      FROM raw_ship_requests) v WHERE message IS NOT NULL GROUP BY message""", "raw_ship_requests")
def _(spark, sf):
    _, quarantine = validation.split_valid(validation.validate_ship(tables.raw_ship_requests(spark, sf)))
    return quarantine.groupBy("message").agg(F.count(F.lit(1)).alias("requests"))


@query("val_1_ship_bodies", """
    SELECT request_id, CASE WHEN message IS NOT NULL THEN 'INVALID_REQUEST' END AS code, message
    FROM (SELECT request_id, CASE WHEN NOT json_valid(body) THEN 'Invalid JSON in request body'
        WHEN coalesce(json_type(body, '$.warehouseId'), '') <> 'VARCHAR' OR body->>'$.warehouseId' = ''
          THEN 'warehouseId is required and must be a string'
        WHEN coalesce(json_type(body, '$.itemId'), '') <> 'VARCHAR' OR body->>'$.itemId' = ''
          THEN 'itemId is required and must be a string'
        WHEN coalesce(json_type(body, '$.quantity'), '') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')
          OR NOT (TRY_CAST(body->>'$.quantity' AS DOUBLE) > 0)
          THEN 'quantity is required and must be a positive number'
        WHEN coalesce(body->>'$.table', '') NOT IN ('bad', 'good', 'goodGsi', 'badOnDemand')
          THEN 'table is required and must be "bad", "good", "goodGsi" or "badOnDemand"' END AS message
      FROM ship_bodies) v""", "ship_bodies")
def _(spark, sf):
    parsed = validation.parse_ship_bodies(tables.ship_bodies(spark, sf))
    return validation.validate_ship(parsed).select("request_id", "code", "message")


_TABLE = """WHEN variant NOT IN ('bad', 'good', 'goodGsi', 'badOnDemand')
      THEN 'table is required and must be "bad", "good", "goodGsi" or "badOnDemand"'"""


@query("val_2_load_runs", f"""
    SELECT request_id, CASE WHEN message IS NOT NULL THEN 'INVALID_REQUEST' END AS code, message
    FROM (SELECT request_id, CASE {_TABLE}
        WHEN NOT (duration_seconds > 0 AND duration_seconds <= 300)
          THEN 'durationSeconds is required and must be a number between 1 and 300'
        WHEN NOT (requests_per_second > 0 AND requests_per_second <= 4000)
          THEN 'requestsPerSecond is required and must be a number between 1 and 4000'
        WHEN NOT (tokyo BETWEEN 0 AND 1) THEN 'warehouseDistribution.WH-TOKYO must be a number between 0.0 and 1.0'
        WHEN NOT (osaka BETWEEN 0 AND 1) THEN 'warehouseDistribution.WH-OSAKA must be a number between 0.0 and 1.0'
        WHEN NOT (fukuoka BETWEEN 0 AND 1)
          THEN 'warehouseDistribution.WH-FUKUOKA must be a number between 0.0 and 1.0'
        WHEN NOT (abs(tokyo + osaka + fukuoka - 1.0) <= 0.01)
          THEN 'warehouseDistribution values must sum to approximately 1.0' END AS message
      FROM run_requests) v""", "run_requests")
def _(spark, sf):
    checked = validation.validate_run(tables.run_requests(spark, sf), "load")
    return checked.select("request_id", "code", "message")


@query("val_2_impact_runs", f"""
    SELECT request_id, CASE WHEN message IS NOT NULL THEN 'INVALID_REQUEST' END AS code, message
    FROM (SELECT request_id, CASE {_TABLE}
        WHEN NOT (requests_per_second BETWEEN 1 AND 200)
          THEN 'requestsPerSecond is required and must be between 1 and 200'
        WHEN NOT (duration_seconds BETWEEN 1 AND 60)
          THEN 'durationSeconds is required and must be between 1 and 60'
        WHEN NOT (coalesce(iterations, 1) = floor(coalesce(iterations, 1)) AND coalesce(iterations, 1) BETWEEN 1 AND 12)
          THEN 'iterations must be an integer between 1 and 12'
        WHEN coalesce(iterations, 1) * duration_seconds > 240
          THEN 'iterations * durationSeconds must not exceed 240 seconds' END AS message
      FROM run_requests) v""", "run_requests")
def _(spark, sf):
    checked = validation.validate_run(tables.run_requests(spark, sf), "impact")
    return checked.select("request_id", "code", "message")


SHIPPED = """WITH RECURSIVE numbered AS (
      SELECT r.*, row_number() OVER (PARTITION BY r.item_id, r.warehouse_id ORDER BY r.ts, r.request_id) AS rn,
        coalesce(s.quantity, 0) AS stock_quantity
      FROM ship_requests r LEFT JOIN opening_stock s USING (item_id, warehouse_id)),
    shipped AS (
      SELECT item_id, warehouse_id, request_id, ts, rn, quantity, quantity <= stock_quantity AS accepted,
        CASE WHEN quantity <= stock_quantity THEN stock_quantity - quantity ELSE stock_quantity END AS stock_after
      FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.item_id, n.warehouse_id, n.request_id, n.ts, n.rn, n.quantity, n.quantity <= s.stock_after,
        CASE WHEN n.quantity <= s.stock_after THEN s.stock_after - n.quantity ELSE s.stock_after END
      FROM shipped s JOIN numbered n ON n.item_id = s.item_id AND n.warehouse_id = s.warehouse_id AND n.rn = s.rn + 1)
"""
_ANSWER = """SELECT request_id, item_id, warehouse_id, quantity, accepted, stock_after,
    CASE WHEN NOT accepted THEN 'INSUFFICIENT_STOCK' END AS code,
    CASE WHEN NOT accepted THEN 'Insufficient stock. Current: ' || stock_after || ', Requested: ' || quantity END
      AS message, CASE WHEN accepted THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS last_updated
    FROM shipped"""


@query("sta_1_conditional_decrement", SHIPPED + _ANSWER, "ship_requests opening_stock")
def _(spark, sf):
    decided = ledger.ship_batch(tables.opening_stock(spark, sf), tables.ship_requests(spark, sf))
    return ledger.ship_responses(decided).drop("ts")


@query("val_1_bodies_to_stock", """WITH RECURSIVE valid AS (
      SELECT request_id, body->>'$.warehouseId' AS warehouse_id, body->>'$.itemId' AS item_id,
        CAST(body->>'$.quantity' AS DECIMAL(18, 6)) AS quantity
      FROM ship_bodies WHERE CASE WHEN json_valid(body) THEN coalesce(json_type(body, '$.warehouseId'), '') = 'VARCHAR'
        AND coalesce(json_type(body, '$.itemId'), '') = 'VARCHAR'
        AND coalesce(json_type(body, '$.quantity'), '') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
        AND TRY_CAST(body->>'$.quantity' AS DOUBLE) > 0
        AND coalesce(body->>'$.table', '') IN ('bad', 'good', 'goodGsi', 'badOnDemand') ELSE false END),
    numbered AS (
      SELECT v.*, row_number() OVER (PARTITION BY v.item_id, v.warehouse_id ORDER BY v.request_id) AS rn,
        coalesce(s.quantity, 0)::DECIMAL(18, 6) AS stock_quantity
      FROM valid v LEFT JOIN opening_stock s USING (item_id, warehouse_id)),
    shipped AS (
      SELECT item_id, warehouse_id, request_id, rn, quantity, quantity <= stock_quantity AS accepted,
        (CASE WHEN quantity <= stock_quantity THEN stock_quantity - quantity ELSE stock_quantity END)::DECIMAL(18, 6)
          AS stock_after
      FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.item_id, n.warehouse_id, n.request_id, n.rn, n.quantity, n.quantity <= s.stock_after,
        (CASE WHEN n.quantity <= s.stock_after THEN s.stock_after - n.quantity ELSE s.stock_after END)::DECIMAL(18, 6)
      FROM shipped s JOIN numbered n ON n.item_id = s.item_id AND n.warehouse_id = s.warehouse_id AND n.rn = s.rn + 1)
    SELECT request_id, item_id, warehouse_id, quantity::DOUBLE AS quantity, accepted,
      stock_after::DOUBLE AS stock_after FROM shipped""", "ship_bodies opening_stock")
def _(spark, sf):
    """Request bodies parsed, checked, and the valid ones decided, fractions included.

    Parsed bodies are stored: filters on their fields would parse each body again for every rule and pass.
    """
    parsed = written_table(validation.parse_ship_bodies(tables.ship_bodies(spark, sf)), "ship-bodies")
    checked = validation.validate_ship(parsed)
    valid, _ = validation.split_valid(checked)
    exact, _ = validation.split_valid(validation.exact_quantities(valid))
    wanted = exact.select("request_id", "item_id", "warehouse_id", "quantity")
    decided = ledger.ship_batch(tables.opening_stock(spark, sf), wanted, order=["request_id"])
    return decided.withColumns({c: F.col(c).cast("double") for c in ("quantity", "stock_after")})


@query("sta_1_sliced_decrement", SHIPPED + _ANSWER, "ship_requests opening_stock")
def _(spark, sf):
    """The path for hot keys, taken here by every item with more than 60 requests."""
    decided = ledger.ship_batch(
        tables.opening_stock(spark, sf), tables.ship_requests(spark, sf), hot_rows=60
    )
    return ledger.ship_responses(decided).drop("ts")


@query("sta_1_closing_stock", SHIPPED + """
    SELECT o.item_id, o.warehouse_id, o.quantity - coalesce(taken, 0) AS quantity,
      strftime(last_shipped, '%Y-%m-%d %H:%M:%S') AS last_shipped
    FROM opening_stock o LEFT JOIN (SELECT item_id, warehouse_id,
        sum(quantity) FILTER (accepted)::BIGINT AS taken, max(ts) FILTER (accepted) AS last_shipped
      FROM shipped GROUP BY ALL) t USING (item_id, warehouse_id)""", "ship_requests opening_stock")
def _(spark, sf):
    stock = tables.opening_stock(spark, sf)
    closing = ledger.closing_stock(stock, ledger.ship_batch(stock, tables.ship_requests(spark, sf)))
    return closing.withColumn("last_shipped", F.date_format("last_shipped", "yyyy-MM-dd HH:mm:ss"))


@query("join_3_stock_lookup", """
    SELECT r.request_id, r.item_id, r.warehouse_id, r.quantity, coalesce(s.quantity, 0) AS stock_quantity
    FROM ship_requests r LEFT JOIN opening_stock s USING (item_id, warehouse_id)""", "ship_requests opening_stock")
def _(spark, sf):
    return ledger.stock_lookup(tables.ship_requests(spark, sf), tables.opening_stock(spark, sf)).drop("ts")


@query("sta_3_counter_bump", """
    SELECT coalesce(b.item_id, e.item_id) AS item_id, coalesce(b.warehouse_id, e.warehouse_id) AS warehouse_id,
      coalesce(b.quantity, 0) + coalesce(e.n, 0) AS counter
    FROM opening_stock b FULL OUTER JOIN (SELECT item_id, warehouse_id, count(*) AS n FROM ship_requests GROUP BY ALL) e
      ON b.item_id = e.item_id AND b.warehouse_id = e.warehouse_id""", "ship_requests opening_stock")
def _(spark, sf):
    base = tables.opening_stock(spark, sf).withColumnRenamed("quantity", "counter")
    return ledger.bump(base, tables.ship_requests(spark, sf), ["item_id", "warehouse_id"])


@query("led_1_stock_from_movements", """
    SELECT warehouse_id, item_id, sum(signed_quantity)::BIGINT AS stock_quantity,
      sum(greatest(signed_quantity, 0))::BIGINT AS received, sum(greatest(-signed_quantity, 0))::BIGINT AS shipped,
      count(*) AS movements FROM movements GROUP BY ALL""", "movements")
def _(spark, sf):
    return ledger.stock_from_movements(movements(spark, sf))


@query("led_1_running_balance", """
    SELECT warehouse_id, period, net, sum(net) OVER (PARTITION BY warehouse_id ORDER BY period)::BIGINT AS balance
    FROM (SELECT warehouse_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period,
        sum(signed_quantity)::BIGINT AS net FROM movements GROUP BY ALL) m""", "movements")
def _(spark, sf):
    return ledger.running_balance(movements(spark, sf))


@query("led_2_movement_history", """
    SELECT item_id, strftime(ts, '%Y-%m') AS period, type, count(*) AS movements,
      sum(signed_quantity)::BIGINT AS net_quantity
    FROM movements WHERE starts_with(item_id, 'ITEM#ETH-') AND ts >= TIMESTAMP '1999-01-01'
      AND ts < TIMESTAMP '2000-01-01' GROUP BY ALL""", "movements")
def _(spark, sf):
    return ledger.movement_history(
        movements(spark, sf), item_prefix="ITEM#ETH-", since="1999-01-01", until="2000-01-01"
    )


@query("led_2_movement_log", """
    SELECT warehouse_id, item_id, type, signed_quantity, strftime(ts, '%Y-%m-%d') AS day FROM movements
    WHERE starts_with(item_id, 'ITEM#KEN-') AND ts >= TIMESTAMP '2000-06-01'
    ORDER BY ts DESC, warehouse_id, item_id""", "movements")
def _(spark, sf):
    log = ledger.movement_log(movements(spark, sf), "ITEM#KEN-", since="2000-06-01")
    return log.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).drop("ts")


@query("led_3_by_lot", """
    SELECT lot_number, warehouse_id, count(*) AS items, sum(quantity)::BIGINT AS quantity FROM inventory
    GROUP BY ALL""", "inventory")
def _(spark, sf):
    return ledger.by_lot(inventory(spark, sf))


@query("led_4_low_stock", """
    SELECT warehouse_id, item_id, stock_quantity, stock_quantity <= 0 AS stock_out
    FROM (SELECT warehouse_id, item_id, sum(signed_quantity)::BIGINT AS stock_quantity FROM movements GROUP BY ALL) s
    WHERE stock_quantity <= 10""", "movements")
def _(spark, sf):
    levels = ledger.stock_from_movements(movements(spark, sf)).select("warehouse_id", "item_id", "stock_quantity")
    return ledger.low_stock(levels, 10, "stock_quantity")


@query("led_5_stocktake", """
    SELECT coalesce(i.warehouse_id, m.warehouse_id) AS warehouse_id, coalesce(i.item_id, m.item_id) AS item_id,
      coalesce(i.quantity, 0) AS counted_quantity, coalesce(m.q, 0) AS ledger_quantity,
      coalesce(i.quantity, 0) - coalesce(m.q, 0) AS variance,
      CASE WHEN m.item_id IS NULL THEN 'not in ledger' WHEN i.item_id IS NULL THEN 'not counted' ELSE 'both' END
        AS presence
    FROM inventory i FULL OUTER JOIN (SELECT warehouse_id, item_id, sum(signed_quantity)::BIGINT AS q
      FROM movements GROUP BY ALL) m ON i.item_id = m.item_id AND i.warehouse_id = m.warehouse_id""",
    "inventory movements")
def _(spark, sf):
    return ledger.stocktake(inventory(spark, sf), movements(spark, sf))
