"""Operators that keep hot keys from landing in one task, and reports about skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.session import written_table

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def ordered_positions(
    df: DataFrame, order: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Adds ``position`` (increasing in the given order) and ``chunk`` (a slice of it).

    Rows are range-partitioned on the whole order, so one hot value is cut into
    many chunks as long as the order ends in a unique column.  Range bounds are
    sampled anew whenever a plan is evaluated again; the result is therefore
    written to the shared folder before anything depends on the chunks.
    """
    count = [partitions] if partitions else []
    placed = (
        df.repartitionByRange(*count, *order)
        .sortWithinPartitions(*order)
        .withColumn("position", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("position", _POSITION_BITS))
    )
    return written_table(placed, "positions")


def global_rank(
    df: DataFrame, order: Sequence[str], within: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``rank`` (from 1) in the given order inside each ``within`` group.

    ``row_number`` over a large group sorts that group in one task.  Here each
    chunk is counted, and a row's rank is the rows before its chunk plus its
    place in the chunk.  The counts table has at most chunks + groups rows.
    """
    placed = ordered_positions(df, [*within, *order], partitions)
    counts = placed.groupBy(*within, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("first_position")
    )
    # Without groups this window holds one row per chunk.
    before = Window.partitionBy(*within).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *within, "chunk", "first_position",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    if not within:
        offsets = F.broadcast(offsets)  # one row per chunk
    return (
        placed.join(offsets, [*within, "chunk"])
        .withColumn("rank", F.col("offset") + F.col("position") - F.col("first_position") + 1)
        .drop("chunk", "position", "first_position", "offset")
    )


def chunked_running_sum(df: DataFrame, keys: Sequence[str], value: Column, into: str) -> DataFrame:
    """Exact running sum of ``value`` before each row, along ``position``, per key.

    Needs the ``chunk`` and ``position`` columns of :func:`ordered_positions`.
    The largest sorted group is one chunk of one key, never a whole key.
    """
    valued = df.withColumn("_value", value)
    totals = valued.groupBy(*keys, "chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *keys, "chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*keys, "chunk").orderBy("position").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        valued.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(bases, [*keys, "chunk"])
        .withColumn(into, F.col("_base") + F.col("_inside"))
        .drop("_value", "_inside", "_base")
    )


def shard_of(col: Column, shards: int, how: str = "hash") -> Column:
    """Shard number: hash of the column, its value, or of its first character."""
    if how == "hash":
        return F.pmod(F.xxhash64(col), F.lit(shards)).cast("int")
    if how == "value":
        return F.pmod(col, F.lit(shards)).cast("int")
    if how == "first_char":
        return F.pmod(F.ascii(col), F.lit(shards)).cast("int")
    raise ValueError(f"unknown sharding: {how}")


def sharded_key(key: Column, shard: Column) -> Column:
    """Key with a shard suffix, such as ``DAILY#3``."""
    return F.concat_ws("#", key, shard.cast("string"))


def salted_totals(
    df: DataFrame, key: str, salt: str, value: str, shards: int, how: str = "hash"
) -> DataFrame:
    """Count and sum per key through (key, shard) pieces that are added up on read."""
    pieces = df.groupBy(key, shard_of(F.col(salt), shards, how).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )
    return pieces.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("shards_used")
    )


def time_bucket(key: Column, ts: Column) -> Column:
    """Key with its hour, such as ``LINE-A#2026-05-26T14``."""
    return F.concat_ws("#", key, F.date_format(ts, "yyyy-MM-dd'T'HH"))


def composite_key(*parts: Column | tuple[Column, int]) -> Column:
    """Parts joined by ``#``; a (number, width) pair is zero-padded so text order is number order."""
    return F.concat_ws("#", *[
        F.lpad(p[0].cast("string"), p[1], "0") if isinstance(p, tuple) else p for p in parts
    ])


def prefix_levels(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum at each level of a ``#`` key, narrowing from the left.

    Rows shrink to one per whole key before they are copied to their levels.
    """
    whole = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    parts = F.split(F.col(key), "#")
    levels = whole.select(
        "n", "total",
        F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.struct(
                i.alias("level"), F.concat_ws("#", F.slice(parts, F.lit(1), i)).alias("prefix")
            ),
        )).alias("at"),
    )
    return levels.groupBy(F.col("at.level").alias("level"), F.col("at.prefix").alias("prefix")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )


def segment_skew(df: DataFrame, key: str, segments: int, how: str = "hash") -> DataFrame:
    """Rows and distinct keys per hash segment, empty segments included."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    filled = per_key.groupBy(shard_of(F.col(key), segments, how).alias("segment")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    )
    empty = df.sparkSession.range(segments).select(
        F.col("id").cast("int").alias("segment"),
        F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).cast("bigint").alias("n_keys"),
    )
    return filled.unionByName(empty).groupBy("segment").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_keys").alias("n_keys")
    )
