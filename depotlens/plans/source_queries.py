"""Catalogue expansion, replacement, layouts and key samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlens.plans.registry import query
from depotlens.schemas import WAREHOUSES
from depotlens.session import shared_dir
from depotlens.sources import catalogue, feed, tables
from depotlens.sources.tables import inventory


def scratch(spark, name: str) -> str:
    """A new folder below the shared one."""
    from uuid import uuid4

    return f"{shared_dir(spark)}/depotlens-{name}-{uuid4().hex}"


@query("src_1_snapshot_json", """
    SELECT warehouse_id, count(*) AS items, sum(quantity)::BIGINT AS quantity, min(item_id) AS first_item,
      max(location) AS last_location FROM inventory GROUP BY warehouse_id""", "inventory")
def _(spark, sf):
    path = scratch(spark, "snapshot")
    inventory(spark, sf).write.json(path)
    return catalogue.read_snapshot(spark, path, "json").groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"),
        F.min("item_id").alias("first_item"), F.max("location").alias("last_location"),
    )


@query("src_2_change_feed", """
    SELECT op, count(*) AS changes, count(DISTINCT item_id) AS items, min(version) AS first_version,
      max(version) AS last_version, coalesce(sum(new_quantity), 0)::BIGINT AS new_quantity FROM changes GROUP BY op""",
    "changes")
def _(spark, sf):
    path, read = scratch(spark, "feed"), scratch(spark, "feed-read")
    tables.changes(spark, sf).write.json(path)
    stream = catalogue.read_changes(spark, path, max_files_per_trigger=4)
    stream.writeStream.format("parquet").option("path", read).option(
        "checkpointLocation", scratch(spark, "feed-checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(read).groupBy("op").agg(
        F.count(F.lit(1)).alias("changes"), F.countDistinct("item_id").alias("items"),
        F.min("version").alias("first_version"), F.max("version").alias("last_version"),
        F.coalesce(F.sum("new_quantity"), F.lit(0)).alias("new_quantity"),
    )


@query("src_2_numbered_feed", """
    SELECT op, count(*) AS changes, count(DISTINCT version) AS versions, strftime(min(arrival_ts), '%Y-%m-%d %H:%M:%S') AS first_arrival,
      coalesce(sum(new_quantity), 0)::BIGINT AS new_quantity, count(*) AS replayed FROM changes GROUP BY op""", "changes")
def _(spark, sf):
    """The feed arrives in two parts, the stream is restarted between them, and the whole of it is read again."""
    path, read, checkpoint = (scratch(spark, name) for name in ("feed", "feed-read", "feed-checkpoint"))
    ledger = f"{checkpoint}/ledger"
    changes = tables.changes(spark, sf)
    for part in (changes.filter("op = 'delete'"), changes.filter("op <> 'delete'")):
        part.write.mode("append").json(path)
        feed.read_feed(spark, path, ledger, "earliest").writeStream.format("parquet").option("path", read).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    replayed = feed.replay_feed(spark, path, ledger, 0, feed.feed_length(path, ledger))
    return spark.read.parquet(read).groupBy("op").agg(
        F.count(F.lit(1)).alias("changes"), F.countDistinct("version").alias("versions"),
        F.date_format(F.min("arrival_ts"), "yyyy-MM-dd HH:mm:ss").alias("first_arrival"),
        F.coalesce(F.sum("new_quantity"), F.lit(0)).alias("new_quantity"),
    ).join(replayed.groupBy("op").agg(F.count(F.lit(1)).alias("replayed")), "op")


@query("src_1_typed_export", """
    SELECT warehouse_id, count(*) AS items, sum(quantity)::BIGINT AS quantity, min(item_id) AS first_item,
      max(unit_price) AS highest_price FROM inventory GROUP BY warehouse_id""", "inventory")
def _(spark, sf):
    path = scratch(spark, "typed-export")
    typed = {"warehouseId": ("warehouse_id", "S"), "itemId": ("item_id", "S"), "quantity": ("quantity", "N"),
             "unitPrice": ("unit_price", "N")}
    item = F.struct(*[F.struct(F.col(c).cast("string").alias(k)).alias(name) for name, (c, k) in typed.items()])
    inventory(spark, sf).select(item.alias("Item")).write.json(path)
    return catalogue.read_typed_export(spark, path).groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"),
        F.min("item_id").alias("first_item"), F.max("unit_price").alias("highest_price"),
    )


@query("src_3_expand_catalogue", """
    SELECT w AS warehouse_id, item_id, item_name, lot_number, location, unit_price
    FROM skus, (SELECT unnest(['WH-TOKYO','WH-OSAKA','WH-FUKUOKA']) AS w) wh""", "skus")
def _(spark, sf):
    return catalogue.expand_catalogue(tables.skus(spark, sf), WAREHOUSES).drop("part_key")


@query("src_4_put_all", """
    SELECT item_id, warehouse_id, CASE WHEN quantity % 2 = 0 THEN 0 ELSE quantity END AS quantity FROM inventory
    UNION ALL
    SELECT item_id, 'WH-NEW' AS warehouse_id, quantity FROM inventory
    WHERE warehouse_id = 'WH-TOKYO' AND quantity % 2 = 0""", "inventory")
def _(spark, sf):
    stock = inventory(spark, sf).select("item_id", "warehouse_id", "quantity")
    even = stock.filter(F.col("quantity") % 2 == 0)
    stale = even.withColumn("seq", F.lit(1)).withColumn("quantity", F.lit(-1).cast("bigint"))
    fresh = even.withColumn("seq", F.lit(2)).withColumn("quantity", F.lit(0).cast("bigint"))
    new = even.filter(F.col("warehouse_id") == "WH-TOKYO").withColumn("warehouse_id", F.lit("WH-NEW"))
    batch = stale.unionByName(fresh).unionByName(new.withColumn("seq", F.lit(1)))
    return catalogue.put_all(stock, batch, seq="seq")


@query("src_5_layouts", """
    SELECT layout, warehouse_id, count(*) AS items, sum(quantity)::BIGINT AS quantity
    FROM inventory, (SELECT unnest(['by_warehouse','by_location','by_unit_price','by_item']) AS layout) l
    GROUP BY ALL""", "inventory")
def _(spark, sf):
    from functools import reduce

    folders = catalogue.write_layouts(inventory(spark, sf), scratch(spark, "layouts"))
    read = [
        spark.read.parquet(path).groupBy("warehouse_id").agg(
            F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity")
        ).withColumn("layout", F.lit(name))
        for name, path in folders.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), read)


@query("src_6a_distinct_items", """
    SELECT DISTINCT item_id FROM inventory ORDER BY item_id LIMIT 2000""", "inventory")
def _(spark, sf):
    return catalogue.distinct_keys(inventory(spark, sf), 2000)


@query("src_6a_capped_items", """
    SELECT DISTINCT item_id FROM inventory ORDER BY item_id LIMIT 150""", "inventory")
def _(spark, sf):
    """A cap below the number of items."""
    return catalogue.distinct_keys(inventory(spark, sf), 150)


@query("src_6b_pairs_of_head", """
    SELECT DISTINCT warehouse_id, item_id FROM (SELECT warehouse_id, item_id FROM inventory
      ORDER BY item_id, warehouse_id LIMIT 1000) head WHERE warehouse_id <> '' AND item_id <> ''""", "inventory")
def _(spark, sf):
    return catalogue.distinct_pairs_of_head(inventory(spark, sf), 1000)


@query("src_6c_probe_keys", """
    SELECT 'bad' AS variant, item_id FROM (SELECT item_id FROM inventory WHERE warehouse_id = 'WH-TOKYO'
      ORDER BY item_id LIMIT 100) a
    UNION ALL
    SELECT DISTINCT 'good', item_id FROM (SELECT item_id FROM inventory ORDER BY item_id, warehouse_id LIMIT 100) b""",
    "inventory")
def _(spark, sf):
    stock = inventory(spark, sf)
    bad = catalogue.probe_keys(stock, "WH-TOKYO", "bad").withColumn("variant", F.lit("bad"))
    good = catalogue.probe_keys(stock, "WH-TOKYO", "good").withColumn("variant", F.lit("good"))
    return bad.unionByName(good)


@query("src_7_export_json", """
    SELECT run_id, count(*) AS requests, count(DISTINCT round) AS rounds FROM requests GROUP BY run_id""", "requests")
def _(spark, sf):
    from depotlens.operators import metrics

    log = tables.requests(spark, sf)
    folders = catalogue.export_results(
        metrics.run_summary(log), metrics.round_summary(log), log, scratch(spark, "export")
    )
    lines = spark.read.schema("run_id string, rounds array<struct<round:int>>").json(folders["runs"])
    sent = spark.read.schema("run_id string, request_id bigint").json(folders["requests"])
    return sent.groupBy("run_id").agg(F.count("request_id").alias("requests")).join(
        lines.select("run_id", F.size("rounds").cast("bigint").alias("rounds")), "run_id"
    )
