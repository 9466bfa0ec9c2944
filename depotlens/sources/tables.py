"""Model tables derived row by row from the given star-schema tables.

No rule here joins or sorts: each view is one projection of one input table, so
it costs no shuffle and grows with its input.  Only the opening stock leaves
rows out: a customer in debt stands for an item without a stock row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.schemas import ITEM_CODES, VARIANTS, WAREHOUSES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files; event times as session timestamps.

    The rate limit bounds what one task can receive in a micro-batch.
    """
    schema = load(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 32)
    stream = reader.parquet(f"{sf_dir}/{name}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """values[index mod len]."""
    return F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int")
    )


def _item_id(key: Column) -> Column:
    return F.concat(
        F.lit("ITEM#"), _pick(ITEM_CODES, key), F.lit("-"), F.lpad(key.cast("string"), 12, "0")
    )


def _events(spark: SparkSession, sf_dir: str, events: DataFrame | None) -> DataFrame:
    return load(spark, sf_dir, "events") if events is None else events


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKU master from ``part``."""
    p = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        p.alias("part_key"),
        _item_id(p).alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.concat(
            F.lit("LOT#2026-05-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"),
            F.lit("-"), F.lpad((p % 999 + 1).cast("string"), 3, "0"),
        ).alias("lot_number"),
        F.concat(
            _pick(tuple("ABCDEFGH"), p), F.lit("-"), F.lpad((p % 20 + 1).cast("string"), 2, "0"),
            F.lit("-"), F.lpad((p % 5 + 1).cast("string"), 2, "0"),
        ).alias("location"),
        F.floor("p_retailprice").alias("unit_price"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per SKU and warehouse; quantity differs by warehouse."""
    from depotlens.sources.catalogue import expand_catalogue

    expanded = expand_catalogue(skus(spark, sf_dir), WAREHOUSES, position="w")
    return expanded.select(
        "warehouse_id", "item_id", "item_name",
        (F.lit(10) + (F.col("part_key") * 37 + F.col("w") * 101) % 991).alias("quantity"),
        "lot_number", "location", "unit_price",
    )


def requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Request log from ``events``; one run per layout variant and day."""
    from depotlens.operators.validation import classify

    e, u = F.col("event_id"), F.col("user_id")
    variant = _pick(VARIANTS, u)
    error = (
        F.when(F.col("event_type") == "error", _pick(
            ("ProvisionedThroughputExceededException", "ThrottlingException",
             "RequestLimitExceeded"), e))
        .when(F.col("event_type") == "signup", F.lit("InternalServerError"))
        .when(F.col("event_type") == "purchase", F.lit("ConditionalCheckFailedException"))
    )
    raw = _events(spark, sf_dir, events).select(
        e.alias("request_id"),
        F.col("ts"),
        variant.alias("variant"),
        F.concat(variant, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        (u % 3).alias("worker"),
        F.floor(F.hour("ts") / 2).cast("int").alias("round"),
        F.second("ts").alias("second"),
        F.floor("value").alias("latency_ms"),
        error.alias("error_name"),
        F.concat(F.lit("ITEM#U"), u.cast("string")).alias("item_id"),
        F.when(u % 10 < 8, WAREHOUSES[0]).when(u % 10 == 8, WAREHOUSES[1])
        .otherwise(WAREHOUSES[2]).alias("warehouse_id"),
        F.when(e % 2 == 1, "key_range").otherwise("capacity").alias("cause"),
        _pick(("byWarehouse", "byLocation", "byUnitPrice"), e).alias("target"),
    )
    return classify(raw, "impact")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RUNNING row per (variant, day) seen in the log, three workers each."""
    return (
        requests(spark, sf_dir)
        .groupBy("run_id", "variant")
        .agg(F.date_trunc("day", F.min("ts")).alias("started_at"))
        .select(
            F.col("run_id").alias("execution_id"), "variant", "started_at",
            F.lit("RUNNING").alias("status"), F.lit(3).alias("worker_count"),
            F.lit(4).alias("declared_rps"),
        )
    )


def ship_requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Every event asks for 1 to 7 pieces of the item of its user."""
    u = F.col("user_id")
    return _events(spark, sf_dir, events).select(
        F.col("event_id").alias("request_id"), "ts",
        _pick(WAREHOUSES, u).alias("warehouse_id"),
        F.concat(F.lit("ITEM#U"), u.cast("string")).alias("item_id"),
        (F.lit(1) + F.col("event_id") % 7).alias("quantity"),
    )


def opening_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening stock from account balances; customers in debt have no stock row."""
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        _pick(WAREHOUSES, c).alias("warehouse_id"),
        F.concat(F.lit("ITEM#U"), c.cast("string")).alias("item_id"),
        F.floor(F.col("c_acctbal") / 100).alias("quantity"),
    )


def raw_ship_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked ship requests: blank ids, non-positive quantities, unknown layouts."""
    u, e = F.col("user_id"), F.col("event_id")
    return load(spark, sf_dir, "events").select(
        e.alias("request_id"),
        F.when(F.col("event_type") == "signup", F.when(e % 2 == 0, F.lit("")))
        .otherwise(_pick(WAREHOUSES, u)).alias("warehouse_id"),
        F.when(u % 10 != 3, F.concat(F.lit("ITEM#U"), u.cast("string"))).alias("item_id"),
        (F.col("value") - 10.0).alias("quantity"),
        F.when(F.col("event_type") == "click", F.lit("legacy"))
        .otherwise(_pick(VARIANTS, u)).alias("variant"),
    )


def ship_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship requests as JSON text: cut short, wrong types, missing fields, or well formed."""
    e, kind = F.col("event_id"), F.col("event_type")
    house = F.when(kind == "signup", F.lit("7")).otherwise(F.lit('"WH-TOKYO"'))
    quantity = F.when(e % 5 == 0, F.concat(F.lit('"'), e.cast("string"), F.lit('"'))).when(
        e % 5 == 1, F.col("value").cast("string")
    ).otherwise((e % 4).cast("string"))
    text = F.concat(
        F.lit('{"warehouseId": '), house, F.lit(', "itemId": "ITEM#U'), F.col("user_id").cast("string"),
        F.lit('", "quantity": '), quantity, F.when(kind != "click", F.lit(', "table": "good"}')).otherwise("}"),
    )
    return load(spark, sf_dir, "events").select(
        e.alias("request_id"), F.when(kind == "error", F.substring(text, 1, 20)).otherwise(text).alias("body")
    )


def run_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run configurations of varying validity, one per order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    tokyo, osaka = (o % 11) / 10, (c % 6) / 10
    rest = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0.1)).otherwise(1 - tokyo - osaka)
    return load(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.when(F.col("o_orderstatus") == "P", F.lit("legacy")).otherwise(_pick(VARIANTS, c))
        .alias("variant"),
        F.floor(F.col("o_totalprice") / 1500).cast("double").alias("duration_seconds"),
        (c % 900 * 5).cast("double").alias("requests_per_second"),
        F.when(o % 5 != 0, ((o % 29) / 2).cast("double")).alias("iterations"),
        F.create_map(
            F.lit(WAREHOUSES[0]), tokyo, F.lit(WAREHOUSES[1]), osaka, F.lit(WAREHOUSES[2]), rest
        ).alias("warehouse_distribution"),
    )


def changes(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Change feed from ``events``: delivered up to 29 h after the change."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    amount = F.floor("value")
    return _events(spark, sf_dir, events).select(
        F.when(kind == "error", "delete").otherwise("index").alias("op"),
        e.alias("version"),
        F.col("ts").alias("event_ts"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), (e % 30).cast("int"))).alias("arrival_ts"),
        _pick(WAREHOUSES, u).alias("warehouse_id"),
        F.concat(F.lit("ITEM#U"), u.cast("string")).alias("item_id"),
        F.when(kind != "signup", F.floor(amount / 2)).alias("old_quantity"),
        F.when(kind != "error", amount).alias("new_quantity"),
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock movements from ``lineitem``: N ships, A and R bring goods in."""
    pieces = F.col("l_quantity").cast("bigint")
    return load(spark, sf_dir, "lineitem").select(
        _pick(WAREHOUSES, F.col("l_suppkey")).alias("warehouse_id"),
        _item_id(F.col("l_partkey")).alias("item_id"),
        F.when(F.col("l_returnflag") == "N", "ship")
        .when(F.col("l_returnflag") == "A", "receive").otherwise("return").alias("type"),
        F.when(F.col("l_returnflag") == "N", -pieces).otherwise(pieces).alias("signed_quantity"),
        F.col("l_shipdate").alias("ts"),
    )


# The same views as common table expressions for the SQL equivalents.
_WH = "['WH-TOKYO','WH-OSAKA','WH-FUKUOKA']"
_CODES = "['ETH','BRA','COL','GTM','KEN','IDN','CRI','TZA','BLEND','DRIP','MAT']"
_VARIANTS = "['bad','good','goodGsi','badOnDemand']"

SQL_VIEWS = {
    "skus": f"""
        SELECT p_partkey AS part_key,
          'ITEM#' || {_CODES}[p_partkey % 11 + 1] || '-' || lpad(p_partkey::VARCHAR, 12, '0') AS item_id,
          p_name AS item_name,
          'LOT#2026-05-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '-'
            || lpad((p_partkey % 999 + 1)::VARCHAR, 3, '0') AS lot_number,
          ['A','B','C','D','E','F','G','H'][p_partkey % 8 + 1] || '-'
            || lpad((p_partkey % 20 + 1)::VARCHAR, 2, '0') || '-'
            || lpad((p_partkey % 5 + 1)::VARCHAR, 2, '0') AS location,
          floor(p_retailprice)::BIGINT AS unit_price
        FROM part""",
    "inventory": f"""
        SELECT {_WH}[w + 1] AS warehouse_id, item_id, item_name,
          10 + (part_key * 37 + w * 101) % 991 AS quantity, lot_number, location, unit_price
        FROM skus, (SELECT unnest([0, 1, 2]) AS w) AS wh""",
    "requests": f"""
        SELECT event_id AS request_id, ts, {_VARIANTS}[user_id % 4 + 1] AS variant,
          {_VARIANTS}[user_id % 4 + 1] || '-' || strftime(ts, '%Y%m%d') AS run_id,
          user_id % 3 AS worker, (hour(ts) // 2)::INTEGER AS round, second(ts)::INTEGER AS second,
          floor(value)::BIGINT AS latency_ms, error_name,
          CASE WHEN error_name IN ('ProvisionedThroughputExceededException', 'ThrottlingException')
               THEN 'throttled'
               WHEN error_name IS NULL OR error_name = 'ConditionalCheckFailedException' THEN 'success'
               ELSE 'error' END AS status,
          'ITEM#U' || user_id AS item_id,
          CASE WHEN user_id % 10 < 8 THEN 'WH-TOKYO' WHEN user_id % 10 = 8 THEN 'WH-OSAKA'
               ELSE 'WH-FUKUOKA' END AS warehouse_id,
          CASE WHEN event_id % 2 = 1 THEN 'key_range' ELSE 'capacity' END AS cause,
          ['byWarehouse','byLocation','byUnitPrice'][event_id % 3 + 1] AS target
        FROM (SELECT *, CASE event_type
            WHEN 'error' THEN ['ProvisionedThroughputExceededException','ThrottlingException',
                               'RequestLimitExceeded'][event_id % 3 + 1]
            WHEN 'signup' THEN 'InternalServerError'
            WHEN 'purchase' THEN 'ConditionalCheckFailedException' END AS error_name
          FROM events) AS named""",
    "runs": """
        SELECT run_id AS execution_id, variant, date_trunc('day', min(ts)) AS started_at,
          'RUNNING' AS status, 3 AS worker_count, 4 AS declared_rps
        FROM requests GROUP BY run_id, variant""",
    "ship_requests": f"""
        SELECT event_id AS request_id, ts, {_WH}[user_id % 3 + 1] AS warehouse_id,
          'ITEM#U' || user_id AS item_id, 1 + event_id % 7 AS quantity
        FROM events""",
    "opening_stock": f"""
        SELECT {_WH}[c_custkey % 3 + 1] AS warehouse_id, 'ITEM#U' || c_custkey AS item_id,
          floor(c_acctbal / 100)::BIGINT AS quantity
        FROM customer WHERE c_acctbal >= 0""",
    "raw_ship_requests": f"""
        SELECT event_id AS request_id,
          CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '' END
               ELSE {_WH}[user_id % 3 + 1] END AS warehouse_id,
          CASE WHEN user_id % 10 <> 3 THEN 'ITEM#U' || user_id END AS item_id,
          value - 10.0 AS quantity,
          CASE WHEN event_type = 'click' THEN 'legacy' ELSE {_VARIANTS}[user_id % 4 + 1] END AS variant
        FROM events""",
    "ship_bodies": """
        SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN substr(body, 1, 20) ELSE body END AS body
        FROM (SELECT event_id, event_type, '{"warehouseId": '
            || CASE WHEN event_type = 'signup' THEN '7' ELSE '"WH-TOKYO"' END || ', "itemId": "ITEM#U' || user_id
            || '", "quantity": ' || CASE WHEN event_id % 5 = 0 THEN '"' || event_id || '"'
              WHEN event_id % 5 = 1 THEN value::VARCHAR ELSE (event_id % 4)::VARCHAR END
            || CASE WHEN event_type <> 'click' THEN ', "table": "good"}' ELSE '}' END AS body
          FROM events) t""",
    "run_requests": f"""
        SELECT request_id, variant, duration_seconds, requests_per_second, iterations, tokyo, osaka,
          CASE WHEN low THEN 0.1::DOUBLE ELSE 1 - tokyo - osaka END AS fukuoka
        FROM (SELECT o_orderkey AS request_id,
            CASE WHEN o_orderstatus = 'P' THEN 'legacy' ELSE {_VARIANTS}[o_custkey % 4 + 1] END AS variant,
            floor(o_totalprice / 1500) AS duration_seconds,
            (o_custkey % 900 * 5)::DOUBLE AS requests_per_second,
            CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 29)::DOUBLE / 2 END AS iterations,
            (o_orderkey % 11)::DOUBLE / 10 AS tokyo, (o_custkey % 6)::DOUBLE / 10 AS osaka,
            o_orderpriority = '5-LOW' AS low
          FROM orders) AS parts""",
    "changes": f"""
        SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS op,
          event_id AS version, ts AS event_ts, ts + to_hours(event_id % 30) AS arrival_ts,
          {_WH}[user_id % 3 + 1] AS warehouse_id, 'ITEM#U' || user_id AS item_id,
          CASE WHEN event_type <> 'signup' THEN floor(value)::BIGINT // 2 END AS old_quantity,
          CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT END AS new_quantity
        FROM events""",
    "movements": f"""
        SELECT {_WH}[l_suppkey % 3 + 1] AS warehouse_id,
          'ITEM#' || {_CODES}[l_partkey % 11 + 1] || '-' || lpad(l_partkey::VARCHAR, 12, '0') AS item_id,
          CASE l_returnflag WHEN 'N' THEN 'ship' WHEN 'A' THEN 'receive' ELSE 'return' END AS type,
          CASE l_returnflag WHEN 'N' THEN -l_quantity::BIGINT ELSE l_quantity::BIGINT END AS signed_quantity,
          l_shipdate AS ts
        FROM lineitem""",
}
_NEEDS = {"inventory": ("skus",), "runs": ("requests",)}


def with_views(names: str, body: str) -> str:
    """A SELECT preceded by the named views and the views they read."""
    wanted: list[str] = []
    for name in names.split():
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in wanted:
                wanted.append(needed)
    listed = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {listed},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {listed},\n{body[4:]}"
    return f"WITH {listed}\n{body}"
