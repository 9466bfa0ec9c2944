"""Stock kept in order on disk, and pages read from a few of its files.

A page along an ordered axis needs twenty rows.  Finding them with a top-k reads
a whole warehouse.  Each ordered view therefore has a small table with the first
and last place and the row count of every file; it tells which files hold the
page.  The table has one row per file, and a page needs at most about one file
per row of the page, however large the warehouse is.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.functions.scalar import decode_token
from depotlens.operators.paging import axis_order
from depotlens.schemas import PAGE_SIZE

# Name and axis of each ordered view.
AXES = {"by_warehouse": "item_id", "by_location": "location", "by_unit_price": "unit_price"}
HIGHEST_CHARACTER = chr(0x10FFFF)
#: Item ids lie anywhere in a layout ordered by another column, so their ranges exclude no file.  A Bloom filter in
#: each row group, sized to its ids, does; ids hardly repeat there, and a dictionary would take the filter's place.
POINT_READS = {
    "parquet.bloom.filter.enabled#item_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#item_id": "false",
}


def write_ordered_view(df: DataFrame, path: str, axis: str, files: int | None = None) -> None:
    """Rows split by ranges of (warehouse, axis, key) and sorted inside each file.

    Hashing by warehouse would keep as many tasks busy as there are warehouses.
    Ranges spread a large warehouse over many files.
    """
    count = [files] if files else []
    order = list(dict.fromkeys(["warehouse_id", *axis_order(axis)]))
    (
        df.repartitionByRange(*count, *order).sortWithinPartitions(*order)
        .write.mode("overwrite").options(**POINT_READS).partitionBy("warehouse_id").parquet(f"{path}/rows")
    )
    place = F.struct(*_place(axis))
    df.sparkSession.read.parquet(f"{path}/rows").groupBy(
        "warehouse_id", F.col("_metadata.file_path").alias("file")
    ).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def _place(axis: str) -> list[str]:
    return [c for c in axis_order(axis) if c != "warehouse_id"]


@dataclass(frozen=True)
class OrderedView:
    """One written view.  ``slice`` gives the rows that can be on a page."""

    spark: SparkSession
    path: str
    axis: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def slice(
        self, warehouse_id: str, start: object = None, prefix: str | None = None,
        order: str | None = None, token: str | None = None, size: int = PAGE_SIZE,
    ) -> DataFrame:
        """All rows of the files that hold the next ``size`` + 1 rows of a listing.

        ``start`` is the bound the listing begins at (the lower one, or the upper
        one of a descending listing); ``prefix`` the prefix of the axis.  Apply
        the listing's own conditions to the result as to the whole table.
        """
        files = self._files(warehouse_id, start, prefix, order == "desc", token, size + 1)
        if not files:
            return self.rows().filter(F.lit(False))
        reader = self.spark.read.schema(self.rows().schema).option("basePath", f"{self.path}/rows")
        return reader.parquet(*files)

    def _files(self, warehouse_id, start, prefix, descending, token, needed) -> list[str]:
        ranges = self.spark.read.parquet(f"{self.path}/ranges").filter(
            F.col("warehouse_id") == warehouse_id
        )
        near, far = ("last", "first") if descending else ("first", "last")
        if prefix is not None:
            start = prefix + HIGHEST_CHARACTER if descending else prefix
        reachable, beyond = F.lit(True), F.lit(True)
        if token:
            values = decode_token(token, axis_order(self.axis))
            cursor = F.struct(*[F.lit(values[c]).alias(c) for c in _place(self.axis)])
            reachable = F.col(far) < cursor if descending else F.col(far) > cursor
            beyond = F.col(near) < cursor if descending else F.col(near) > cursor
        elif start is not None:
            edge = F.lit(start)
            reachable = F.col(far)[self.axis] <= edge if descending else F.col(far)[self.axis] >= edge
            beyond = F.col(near)[self.axis] <= edge if descending else F.col(near)[self.axis] >= edge
        # One row per file of this warehouse, so these windows are small.
        direction = F.desc(far) if descending else F.asc(far)
        upto = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        sure = F.sum(F.when(beyond, F.col("n")).otherwise(0)).over(upto)
        reached = F.when(F.col("sure") >= needed, F.col(far))
        bound = (F.max(reached) if descending else F.min(reached)).over(Window.partitionBy())
        counted = ranges.filter(reachable).withColumn("sure", sure).withColumn("bound", bound)
        inside = F.col(near) >= F.col("bound") if descending else F.col(near) <= F.col("bound")
        chosen = counted.filter(F.col("bound").isNull() | inside).select("file")
        return [unquote(r["file"]) for r in chosen.collect()]  # metadata gives paths as URIs


def open_views(spark: SparkSession, path: str) -> dict[str, OrderedView]:
    """The views below a folder, by the axis they are ordered along."""
    return {axis: OrderedView(spark, f"{path}/{name}", axis) for name, axis in AXES.items()}
