"""Stock along a Z-order curve: searches with several ranges at once read few files.

A view ordered by one axis helps a range on that axis alone.  Here price, quantity and location are each cut into
``2 ** BITS`` steps of about equally many rows, and the bits of the three steps are interleaved to one number.  A file
holds the rows of one prefix of that number: a box that is narrow in all three axes.  A search on any of them leaves
out the files whose box it misses.  A small table holds the box of every file.

It pays for ranges on most of its axes: ``n`` files cut each of ``d`` axes into ``n ** (1 / d)`` parts, where a view
ordered by one axis cuts that one into ``n``.  For searches that never name an axis, leave it out of ``axes``.

Steps come from the quantiles of a bounded sample.  They only decide in which file a row lies; a search applies its
conditions to every row it reads, so the answer does not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.operators.search import Criteria, all_of, search
from depotlens.session import written_table
from depotlens.sources.views import HIGHEST_CHARACTER, POINT_READS

CURVE_AXES = ("unit_price", "quantity", "location")
BITS = 6
#: Rows the steps are taken from, those with the least hashes of their keys.
SAMPLE = 10_000


def _steps(df: DataFrame, axes: Sequence[str]) -> list[list[object]]:
    """Upper bounds of all steps but the last, per axis: ``2 ** BITS - 1`` values, fewer where values repeat."""
    sampled = df.orderBy(F.xxhash64("item_id", "warehouse_id")).select(*axes).limit(SAMPLE)

    def quantiles(axis: str) -> Column:
        held, places = F.col(axis), F.sequence(F.lit(1), F.lit(2**BITS - 1))
        values = F.transform(places, lambda i: F.get(held, F.floor(i * F.size(held) / 2**BITS).cast("int")))
        return F.when(F.size(held) > 0, F.array_distinct(values)).alias(axis)

    # One row of at most SAMPLE values an axis.
    row = sampled.agg(*[F.sort_array(F.collect_list(a)).alias(a) for a in axes]).select(*map(quantiles, axes)).first()
    return [row[a] or [] for a in axes]


def _step(column: Column, bounds: list[object]) -> Column:
    """Number of bounds below the value, by halving; 0 for a null."""
    if not bounds:
        return F.lit(0)
    half = len(bounds) // 2
    above = _step(column, bounds[half + 1:]) + half + 1
    return F.when(column > F.lit(bounds[half]), above).otherwise(_step(column, bounds[:half]))


def curve_place(steps: Sequence[Column]) -> Column:
    """Bits of the steps interleaved, the highest of the first axis first."""
    place = F.lit(0).cast("bigint")
    for bit in range(BITS):
        for i, step in enumerate(steps):
            one = F.shiftright(step, bit).bitwiseAND(F.lit(1)).cast("bigint")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(steps) + len(steps) - 1 - i))
    return place


def file_boxes(rows: DataFrame, axes: Sequence[str] = CURVE_AXES, file: Column | None = None) -> DataFrame:
    """``warehouse_id, file, n`` and the least and largest value of every axis, of a written layout."""
    name = F.col("_metadata.file_path") if file is None else file
    return rows.groupBy("warehouse_id", name.alias("file")).agg(
        F.count(F.lit(1)).alias("n"),
        *[how(a).alias(f"{name}_{a}") for a in axes for name, how in (("min", F.min), ("max", F.max))],
    )


def _boxes_of_cells(cells: DataFrame, bits: int, most: int) -> DataFrame:
    """``cell, first, parts``: the file of every cell of ``(warehouse, place), n``, or the first of several.

    A file is the largest aligned box around the cell, a prefix of its place, that holds at most ``most`` rows.  A
    single cell with more is dealt over ``parts`` files.  At most ``2 ** bits`` cells a warehouse, so this is small.
    """
    levels = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn(
        "prefix", F.expr(f"shiftright(_place, {bits} - level)"))
    held = levels.groupBy("warehouse_id", "level", "prefix").agg(
        F.sum("n").alias("held"), F.collect_list(F.struct("warehouse_id", "_place")).alias("cells"))
    fits = (F.col("held") <= most) | (F.col("level") == bits)
    boxes = held.filter(fits).select(F.explode("cells").alias("cell"), "level", "prefix", "held").groupBy("cell").agg(
        F.min(F.struct("level", "prefix", "held")).alias("box"))
    parts = F.ceil(F.col("box.held") / most).cast("int")
    files = boxes.groupBy(F.col("cell.warehouse_id").alias("house"), "box").agg(
        F.collect_list("cell").alias("cells"), F.max(parts).alias("parts"))
    # One row a file, so this window is small.
    before = Window.orderBy("house", F.array_min("cells")).rowsBetween(Window.unboundedPreceding, -1)
    numbered = files.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int"))
    return numbered.select(F.explode("cells").alias("cell"), "first", "parts")


def along_curve(df: DataFrame, files: int | None = None, axes: Sequence[str] = CURVE_AXES) -> DataFrame:
    """The rows in about ``files`` partitions, each an aligned box of one warehouse; one partition becomes one file.

    Ranges of the place alone would begin anywhere, and a range across the border of two boxes covers both.  The
    rows of each cell are counted first; boxes that hold too many are halved until they do not.  Reads ``df`` three times.
    """
    spark = df.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = curve_place([_step(F.col(a), bounds) for a, bounds in zip(axes, _steps(df, axes), strict=True)])
    placed = df.withColumn("_place", place)
    cells = written_table(placed.groupBy("warehouse_id", "_place").agg(F.count(F.lit(1)).alias("n")), "curve-cells")
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Half as much again as the mean, so that boxes of equal size are not halved for a few rows.
    most = max(1, math.ceil(1.5 * total / files))
    boxes = written_table(_boxes_of_cells(cells, BITS * len(axes), most), "curve-boxes")
    n_files = boxes.agg(F.max(F.col("first") + F.col("parts"))).first()[0] or 1
    # Structs with the same null field are equal, so rows without a warehouse find their box.
    numbered = placed.withColumn("cell", F.struct("warehouse_id", "_place")).join(boxes, "cell")
    file = F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    return numbered.withColumn("_file", file).repartitionById(n_files, F.col("_file")).sortWithinPartitions(
        "_file", "_place", "item_id").select(*df.columns)


def write_curve_view(df: DataFrame, path: str, files: int | None = None, axes: Sequence[str] = CURVE_AXES) -> None:
    """One folder a warehouse; the table of boxes, one row a file, goes beside the rows."""
    along_curve(df, files, axes).write.mode("overwrite").options(**POINT_READS).partitionBy("warehouse_id").parquet(
        f"{path}/rows")
    # An empty table leaves no file below the folders of the warehouses, so its columns are kept apart.
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    file_boxes(df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows"), axes).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/boxes")


def meeting(criteria: Criteria, axes: Sequence[str] = CURVE_AXES) -> Column:
    """Of a row of boxes: whether the file can hold a row that meets the criteria.

    A bound that is no ordinary number excludes nothing here.  A file without a value of an axis has null bounds
    and is left out by any range on it, as its rows are.
    """
    tests = []
    if criteria.warehouse_id:
        tests.append(F.col("warehouse_id") == criteria.warehouse_id)
    if criteria.location_prefix and "location" in axes:
        prefix = criteria.location_prefix
        tests.append(F.col("max_location") >= prefix)
        tests.append(F.col("min_location") <= prefix + HIGHEST_CHARACTER)
    for axis, low, high in (
        ("unit_price", criteria.min_price, criteria.max_price), ("quantity", criteria.min_quantity, criteria.max_quantity),
    ):
        if axis in axes:
            tests += [F.col(f"max_{axis}") >= low] if low is not None else []
            tests += [F.col(f"min_{axis}") <= high] if high is not None else []
    return all_of(tests)


@dataclass(frozen=True)
class CurveView:
    """A written view; answers complete searches from the files whose boxes they meet."""

    spark: SparkSession
    path: str
    axes: Sequence[str] = CURVE_AXES

    def rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns).parquet(f"{self.path}/rows")

    def files(self, criteria: Criteria) -> list[str]:
        boxes = self.spark.read.parquet(f"{self.path}/boxes")
        found = boxes.filter(meeting(criteria, self.axes)).select("file").collect()  # names of files only
        return sorted(unquote(r["file"]) for r in found)  # metadata gives paths as URIs

    def search(self, criteria: Criteria) -> DataFrame:
        """The rows :func:`depotlens.operators.search.search` finds in the whole table."""
        files, everything = self.files(criteria), self.rows()
        if not files:
            return everything.filter(F.lit(False))
        reader = self.spark.read.schema(everything.schema).option("basePath", f"{self.path}/rows")
        return search(reader.parquet(*files), criteria)
