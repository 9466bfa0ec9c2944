"""Explicit schemas of the model tables.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# Warehouses, layout variants and the load classes of item ids.
WAREHOUSES = ("WH-TOKYO", "WH-OSAKA", "WH-FUKUOKA")
VARIANTS = ("bad", "good", "goodGsi", "badOnDemand")
INDEXED_VARIANTS = ("good", "goodGsi")
ITEM_CODES = ("ETH", "BRA", "COL", "GTM", "KEN", "IDN", "CRI", "TZA", "BLEND", "DRIP", "MAT")

PAGE_SIZE = 20
PRIMARY_KEY = ("item_id", "warehouse_id")

SKU = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("item_name", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("lot_number", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("unit_price", T.LongType()),
])

INVENTORY = T.StructType([
    T.StructField("warehouse_id", T.StringType(), False),
    *SKU.fields,
    T.StructField("last_updated", T.TimestampType()),
])

CHANGE = T.StructType([
    T.StructField("op", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("arrival_ts", T.TimestampType()),
    T.StructField("item_id", T.StringType(), False),
    T.StructField("warehouse_id", T.StringType(), False),
    T.StructField("old_quantity", T.LongType()),
    T.StructField("new_quantity", T.LongType()),
])

REQUEST = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("variant", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("second", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_name", T.StringType()),
])

SHIP_REQUEST = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("quantity", T.LongType()),
])

RUN = T.StructType([
    T.StructField("execution_id", T.StringType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("worker_count", T.IntegerType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("config", T.StructType([
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("requests_per_second", T.IntegerType()),
        T.StructField("worker_count", T.IntegerType()),
        T.StructField("warehouse_distribution", T.MapType(T.StringType(), T.DoubleType())),
    ])),
])
