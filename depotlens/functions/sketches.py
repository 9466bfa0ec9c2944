"""Mergeable sketches of values and keys that decide where an exact second pass has to look.

*Percentiles.*  A KLL sketch a group bounds the value at a rank from both sides.  Rows outside these bounds are
only counted; the few between them are ranked.  Whether the wanted rank lies between the bounds is known exactly
from the counts, and a group for which it does not is ranked in full, so the sketch never changes a result.

*Keys.*  A theta sketch a segment keeps the least hashes of its keys, ``2 ** LG_KEYS`` of them.  Below that number
its count is exact; above it the relative error is about ``1 / sqrt(2 ** LG_KEYS)``.  Sketches are stored and merged,
so distinct keys of several loads and keys common to two loads need no second look at either.  (Keys are told
apart by their 64-bit hashes: among a billion keys of a segment some 0.03 pairs share one.)

Buffers are bounded: a group has no entry per distinct value, and a segment none per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.operators.skew import chunked_running_sum, ordered_positions, shard_of

#: Size of a KLL sketch: about three times as many values, some 20 KB.
KLL_SIZE = 800
#: One-sided rank error of that size at 99 %, with half as much again on top.  A miss costs time, not the result.
RANK_ERROR = 1.5 * 2.296 / KLL_SIZE**0.9021
#: A theta sketch holds 2 ** 14 hashes, 128 KB; the relative error above that many keys is 0.8 %.
LG_KEYS = 14


def value_sketch(value: str) -> list[Column]:
    """Aggregates of a group: its sketch and the number of its values."""
    return [F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_SIZE).alias("sketch"), F.count(value).alias("n_values")]


def merged_sketch() -> list[Column]:
    """Aggregates over rows of :func:`value_sketch`."""
    held = F.when(F.col("n_values") > 0, F.col("sketch"))
    return [F.kll_merge_agg_double(held, KLL_SIZE).alias("sketch"), F.sum("n_values").alias("n_values")]


def _target(p: int, rule: str) -> Column:
    """Zero-based index of a percentile, in whole numbers as in :mod:`depotlens.functions.percentiles`."""
    return {
        "floor": F.expr(f"least(n_values * {p} div 100, n_values - 1)"),
        "nearest": F.expr(f"(n_values * {p} + 99) div 100 - 1"),
    }[rule].cast("bigint")


def _bounds(sketches: DataFrame, by: Sequence[str], ps: Sequence[int], rule: str) -> DataFrame:
    """A row per (group, percentile): its index, and bounds of its value; a null bound is open."""
    def value(rank: float) -> Column:
        # Ranks of a sketch are literals; an index differs from its rank by less than one value, and small groups
        # for which that matters are cheap to rank in full.
        return F.kll_sketch_get_quantile_double("sketch", F.lit(rank)) if 0 < rank < 1 else F.lit(None).cast("double")

    wanted = F.explode(F.array(*[F.struct(
        F.lit(p).alias("p"), _target(p, rule).alias("at"),
        value(p / 100 - RANK_ERROR).alias("low"), value(p / 100 + RANK_ERROR).alias("high"),
    ) for p in ps]))
    return sketches.filter(F.col("n_values") > 0).select(*by, wanted.alias("w")).select(*by, "w.*")


def narrowed_percentiles(
    df: DataFrame, value: str, by: Sequence[str], ps: Sequence[int], rule: str = "floor", sketches: DataFrame | None = None,
) -> DataFrame:
    """Columns ``p50`` and so on per group: exactly those of ``ranked_percentiles``, 0 where a group has no value.

    ``sketches`` are rows of :func:`value_sketch` per group over the same values, where they exist already; else one
    more pass makes them.  Then one pass counts the values below and between the bounds, and one ranks those between,
    by counted ranges of (group, percentile, value), so that no group meets in one task.  Nulls are no values, NaN is
    the largest one, and groups may have null keys.  ``by`` may be empty: one group.
    """
    names = {name: f"_by{i}" for i, name in enumerate(by)}
    by_ = list(names.values())
    rows = df.select(*[F.col(name).alias(alias) for name, alias in names.items()], F.col(value).alias("v"))
    known = rows.filter(F.col("v").isNotNull()).withColumn("d", F.col("v").cast("double"))
    if sketches is None:
        sketches = rows.groupBy(*by_).agg(*value_sketch("v"))
    else:
        sketches = sketches.select(*[F.col(name).alias(alias) for name, alias in names.items()], "sketch", "n_values")
    bounds = _bounds(sketches, by_, ps, rule)

    def beside(values: DataFrame, limits: DataFrame) -> DataFrame:
        """Values with every percentile of their group; the limits are one row a group."""
        packed = limits.groupBy(*by_).agg(F.collect_list(F.struct("p", "at", "low", "high")).alias("limits"))
        renamed = packed.select(*[F.col(c).alias(f"{c}_l") for c in by_], "limits")
        same = F.lit(True)
        for c in by_:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_l"))
        return values.join(renamed, same).select(*values.columns, "limits")

    def reached(limit: Column, v: Column) -> Column:
        return (limit["low"].isNull() | (v >= limit["low"])) & (limit["high"].isNull() | (v <= limit["high"]))

    # Sums per place in the list, so that a row is not multiplied by the number of percentiles.
    listed = beside(known, bounds)
    counted = listed.groupBy(*by_).agg(
        F.max("limits").alias("limits"),
        *[F.count_if(F.col("d") < F.get("limits", F.lit(i))["low"]).alias(f"below{i}") for i in range(len(ps))],
        *[F.count_if(reached(F.get("limits", F.lit(i)), F.col("d"))).alias(f"between{i}") for i in range(len(ps))],
    )
    checked = counted.select(*by_, F.explode(F.array(*[
        F.struct(F.get("limits", F.lit(i)).alias("limit"), F.col(f"below{i}").alias("below"),
                 F.col(f"between{i}").alias("between")) for i in range(len(ps))
    ])).alias("c")).select(*by_, "c.limit.*", "c.below", "c.between")
    hit = (F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("between"))
    limits = checked.select(
        *by_, "p", F.when(hit, F.col("at") - F.col("below")).otherwise(F.col("at")).alias("at"),
        *[F.when(hit, F.col(c)).alias(c) for c in ("low", "high")],
    )
    near = beside(known, limits).select(*by_, "v", F.explode(F.filter(
        "limits", lambda limit: reached(limit, F.col("d")))).alias("limit"))
    counts = near.groupBy(*by_, F.col("limit.p").alias("p"), F.col("limit.at").alias("at"), "v").agg(
        F.count(F.lit(1)).alias("n"))
    group = [*by_, "p"]
    # Null keys take no part in joins, but structs with the same null fields are equal.
    tagged = counts.withColumn("g", F.struct(*group))
    ranked = chunked_running_sum(ordered_positions(tagged, ["g", "v"]), ["g"], F.col("n"), "before")
    found = ranked.filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    wide = found.groupBy(*by_).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in ps])
    groups = sketches.select(*by_)
    empty = groups.select(*by_, *[F.lit(None).cast(wide.schema[f"p{p}"].dataType).alias(f"p{p}") for p in ps])
    merged = wide.unionByName(empty).groupBy(*by_).agg(*[
        F.coalesce(F.max(f"p{p}"), F.lit(0)).alias(f"p{p}") for p in ps])
    return merged.select(*[F.col(alias).alias(name) for name, alias in names.items()], *[f"p{p}" for p in ps])


# --- distinct keys ---------------------------------------------------------------------------------------------


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys])


def segment_sketches(df: DataFrame, keys: Sequence[str], segments: int = 256) -> DataFrame:
    """``segment, n_rows, keys_sketch`` of every segment of the key space that has rows.

    One pass with map-side merging: what is shuffled is one bounded sketch a task and segment, never a key.
    """
    hashed = df.select(_key_hash(keys).alias("h"))
    return hashed.groupBy(shard_of(F.col("h"), segments).alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.theta_sketch_agg("h", LG_KEYS).alias("keys_sketch"))


def merge_loads(loads: DataFrame) -> DataFrame:
    """Sketches of several loads, rows of :func:`segment_sketches` under each other, as one."""
    return loads.groupBy("segment").agg(
        F.sum("n_rows").alias("n_rows"), F.theta_union_agg("keys_sketch", LG_KEYS).alias("keys_sketch"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``segment, n_rows, n_keys, exact``: distinct keys, and whether their number is exact rather than estimated."""
    n_keys = F.theta_sketch_estimate("keys_sketch")
    return sketches.select("segment", "n_rows", n_keys.alias("n_keys"), (n_keys < 2**LG_KEYS).alias("exact"))


def common_keys(now: DataFrame, last: DataFrame) -> DataFrame:
    """``segment, n_now, n_last, n_common`` of two loads: how much of the last load comes again."""
    def side(sketches: DataFrame, name: str) -> DataFrame:
        return sketches.select("segment", F.col("keys_sketch").alias(name))

    both = side(now, "a").join(side(last, "b"), "segment", "full")
    estimate = lambda c: F.coalesce(F.theta_sketch_estimate(c), F.lit(0).cast("bigint"))
    met = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.theta_sketch_estimate(F.theta_intersection("a", "b")))
    return both.select("segment", estimate("a").alias("n_now"), estimate("b").alias("n_last"),
                       F.coalesce(met, F.lit(0).cast("bigint")).alias("n_common"))


def sketched_key_check(df: DataFrame, keys: Sequence[str], segments: int = 256) -> DataFrame:
    """``row_count, distinct_keys, repeated_keys, ok`` as ``key_check`` gives them.

    Segments whose sketch is exact and counts as many keys as rows hold no repeated key and are settled without
    moving one.  In the others, those with a repeated key and those above the size of a sketch, the keys are counted.
    With enough segments for the table (fewer than ``2 ** LG_KEYS`` keys in each) a clean table moves sketches only.
    """
    # Kept in the shared folder, so that the sums and the choice of segments read one and the same table.
    from depotlens.session import written_table

    known = distinct_estimates(written_table(segment_sketches(df, keys, segments), "key-sketches"))
    settled = F.col("exact") & (F.col("n_keys") == F.col("n_rows"))
    doubtful = known.filter(~settled).select("segment")
    rows = df.select(*keys, shard_of(_key_hash(keys), segments).alias("segment"))
    # At most one row a segment.
    per_key = rows.join(F.broadcast(doubtful), "segment", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counted = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"))
    clean = known.filter(settled).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("distinct_keys"),
        F.lit(0).cast("bigint").alias("repeated_keys"))
    return clean.unionByName(counted).agg(*[F.sum(c).alias(c) for c in clean.columns]).withColumn(
        "ok", F.col("repeated_keys") == 0)
