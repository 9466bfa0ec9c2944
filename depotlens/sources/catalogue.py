"""Building and replacing the stock table, layouts on disk, key samples, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.schemas import CHANGE, INVENTORY, PRIMARY_KEY
from depotlens.sources.views import AXES, POINT_READS, write_ordered_view


def read_snapshot(
    spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = INVENTORY
) -> DataFrame:
    """The whole exported table; the schema is given, so nothing is read to infer it."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_typed_export(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot lines with typed attributes: ``{"Item": {"itemId": {"S": "..."}, "quantity": {"N": "5"}}}``."""
    def camel(name: str) -> str:
        head, *rest = name.split("_")
        return head + "".join(part.title() for part in rest)

    def kind(field: T.StructField) -> str:
        return "N" if isinstance(field.dataType, T.LongType) else "S"

    item = T.StructType([
        T.StructField(camel(f.name), T.StructType([T.StructField(kind(f), T.StringType())]))
        for f in INVENTORY.fields
    ])
    lines = spark.read.schema(T.StructType([T.StructField("Item", item)])).json(path)
    return lines.select(*[
        F.col(f"Item.{camel(f.name)}.{kind(f)}").try_cast(f.dataType).alias(f.name)
        for f in INVENTORY.fields
    ])


def read_changes(
    spark: SparkSession, path: str, stream: bool = True, fmt: str = "json",
    schema: T.StructType = CHANGE, max_files_per_trigger: int | None = None,
    latest_first: bool = False, since_ms: int | None = None,
) -> DataFrame:
    """Change feed.  ``since_ms`` keeps only files written from then on ("latest")."""
    if not stream:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if latest_first:
        reader = reader.option("latestFirst", "true")
    if since_ms is None:
        return reader.load(path)
    return reader.load(path).filter(
        F.col("_metadata.file_modification_time") >= F.timestamp_millis(F.lit(since_ms))
    )


def expand_catalogue(skus: DataFrame, warehouses: Sequence[str], position: str | None = None) -> DataFrame:
    """Each SKU once per warehouse, all values copied.  No join: a fixed list is exploded."""
    pairs = F.posexplode(F.array(*[F.lit(w) for w in warehouses]))
    expanded = skus.select("*", pairs.alias(position or "_position", "warehouse_id"))
    return expanded if position else expanded.drop("_position")


def put_all(
    target: DataFrame, batch: DataFrame, keys: Sequence[str] = PRIMARY_KEY, seq: str | None = None
) -> DataFrame:
    """Full replacement by key; inside the batch the highest ``seq`` wins, and a row without one loses to any other.

    Equal or missing ``seq`` of one key is settled by a hash of the values, so a
    repeated run agrees.  Every batch row outranks the target row.  One shuffle by key with map-side merging: neither an anti-join nor a sorted group is needed.
    """
    values = [c for c in target.columns if c not in keys]
    order = F.coalesce(F.col(seq).cast("bigint"), F.lit(-(1 << 63))) if seq else F.lit(0).cast("bigint")

    def ranked(rows: DataFrame, is_batch: int, seq_: Column) -> DataFrame:
        rank = F.struct(F.lit(is_batch).alias("is_batch"), seq_.alias("seq"), F.xxhash64(*values).alias("tie"))
        return rows.select(*keys, F.struct(*values).alias("row"), rank.alias("rank"))

    old, new = ranked(target, 0, F.lit(0).cast("bigint")), ranked(batch, 1, order)
    merged = old.unionByName(new).groupBy(*keys).agg(F.max_by("row", "rank").alias("row"))
    return merged.select(*[c if c in keys else F.col("row")[c].alias(c) for c in target.columns])


def write_layouts(df: DataFrame, path: str, files: int | None = None) -> dict[str, str]:
    """The same rows under each layout; returns name to folder.

    Three ordered views per warehouse (see :mod:`depotlens.sources.views`), and
    one layout by item whose files cover narrow ranges of item ids.  All carry
    Bloom filters of the item ids, so point reads skip row groups in any layout.
    """
    folders = {}
    for name, axis in AXES.items():
        write_ordered_view(df, f"{path}/{name}", axis, files)
        folders[name] = f"{path}/{name}/rows"
    folders["by_item"] = f"{path}/by_item"
    count = [files] if files else []
    (
        df.repartitionByRange(*count, "item_id", "warehouse_id")
        .sortWithinPartitions("item_id", "warehouse_id")
        .write.mode("overwrite").options(**POINT_READS).parquet(folders["by_item"])
    )
    return folders


def distinct_keys(df: DataFrame, cap: int = 2000, key: str = "item_id") -> DataFrame:
    """The first ``cap`` distinct ids in order (a sampling operator)."""
    return df.select(key).distinct().orderBy(key).limit(cap)


def distinct_pairs_of_head(
    df: DataFrame, n: int = 1000, order: Sequence[str] = ("item_id", "warehouse_id")
) -> DataFrame:
    """Distinct non-blank (warehouse, item) pairs of the first ``n`` rows: cap first."""
    head = df.select("warehouse_id", "item_id").orderBy(*order).limit(n)
    return head.filter((F.col("warehouse_id") != "") & (F.col("item_id") != "")).dropDuplicates()


def probe_keys(df: DataFrame, warehouse: str, variant: str, n: int = 100) -> DataFrame:
    """Item ids to probe: the first keys of one warehouse, or of the whole table.

    Layouts keyed by warehouse read ``n`` rows of that warehouse.  Layouts keyed
    by item read ``n`` rows of everything and then remove repeated ids.
    """
    if variant in ("bad", "badOnDemand"):
        return df.filter(F.col("warehouse_id") == warehouse).select("item_id").orderBy("item_id").limit(n)
    head = df.select("item_id", "warehouse_id").orderBy("item_id", "warehouse_id").limit(n)
    return head.select("item_id").distinct()


def export_results(summaries: DataFrame, rounds: DataFrame, requests: DataFrame, path: str) -> dict[str, str]:
    """Results of runs as JSON lines.

    Each run's line nests its rounds (at most twelve).  Requests go to their own
    files, one line each, under their variant: a run can hold any number of
    them, so they are never gathered into one array.
    """
    nested = rounds.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("round", *[c for c in rounds.columns if c not in ("run_id", "round")])))
        .alias("rounds")
    )
    folders = {"runs": f"{path}/runs", "requests": f"{path}/requests"}
    summaries.join(nested, "run_id", "left").write.mode("overwrite").json(folders["runs"])
    requests.write.mode("overwrite").partitionBy("variant").json(folders["requests"])
    return folders
