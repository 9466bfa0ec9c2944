"""Two percentile rules that give different answers, both exact.

*Nearest rank* takes the ceil(p*n/100)-th value.  *Floor index* takes the value
at zero-based index floor(p*n/100), held inside the list.  For 1..20 at p=95
they give 19 and 20.

Both work on value counts and keep the type of the value.  Latencies are whole
milliseconds, so a group has at most as many counts as there are milliseconds
below the time limit, however many requests it holds.  Where values are so fine
that a group may hold very many different ones, :func:`ranked_profile` finds
the percentiles by counted value ranges, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Measures = Mapping[str, tuple[Column, str]]

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def value_counts(df: DataFrame, value: str, by: Sequence[str], measures: Measures = {}) -> DataFrame:
    """One row per (group, value) with its count ``n`` and mergeable measures.

    A measure is an aggregate and the way its pieces merge: sum, min or max.
    Only fixed-width buffers here, so this is a map-side hash aggregation.
    """
    return df.groupBy(*by, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, (c, _) in measures.items()]
    )


def count_profile(measures: Measures = {}) -> list[Column]:
    """Aggregates over :func:`value_counts` rows: sorted counts, sizes, merged measures."""
    known = F.col("v").isNotNull()
    return [
        F.array_sort(F.collect_list(F.when(known, F.struct("v", "n")))).alias("counts"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_values"),
        F.coalesce(F.sum(F.col("v") * F.col("n")), F.lit(0)).alias("sum_values"),
        F.sum("n").alias("n_rows"),
        *[_MERGE[how](name).alias(name) for name, (_, how) in measures.items()],
    ]


def _values_at(indexes: Sequence[Column]) -> Column:
    """Values at zero-based indexes of the sorted values, in one pass; 0 for an empty group."""
    kept = [F.get("counts", F.lit(0))["v"].alias(f"hit{i}") for i in range(len(indexes))]
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), *kept)

    def step(acc: Column, pair: Column) -> Column:
        seen = acc["seen"]
        hits = [
            F.when((seen <= index) & (seen + pair["n"] > index), pair["v"]).otherwise(acc[f"hit{i}"]).alias(f"hit{i}")
            for i, index in enumerate(indexes)
        ]
        return F.struct((seen + pair["n"]).alias("seen"), *hits)

    return F.aggregate("counts", start, step)


def _value_at(index: Column) -> Column:
    """Value at a zero-based index of the sorted values; 0 for an empty group."""
    return F.coalesce(_values_at([index])["hit0"], F.lit(0))


def _nearest_index(p: int) -> Column:
    """Whole-number arithmetic, so no rank is lost to rounding."""
    return F.expr(f"(n_values * {p} + 99) div 100 - 1")


def _floor_index(p: int) -> Column:
    return F.expr(f"least(n_values * {p} div 100, n_values - 1)")


def nearest_rank(p: int) -> Column:
    """Of a profile row."""
    return _value_at(_nearest_index(p))


def floor_index(p: int) -> Column:
    return _value_at(_floor_index(p))


def profile(
    df: DataFrame, value: str, by: Sequence[str], measures: Measures = {}
) -> DataFrame:
    """Profile per group, ready for :func:`nearest_rank` and :func:`floor_index`."""
    return value_counts(df, value, by, measures).groupBy(*by).agg(*count_profile(measures))


def ranked_percentiles(
    df: DataFrame, value: str, by: Sequence[str], ps: Sequence[int], rule: str = "floor"
) -> DataFrame:
    """Columns ``p50`` and so on per group, for values of any kind; 0 where a group has no value.

    The counts are cut into ranges of (group, value), each range is summed, and
    a percentile is the one count whose range of ranks holds its index.
    """
    from depotlens.operators.skew import chunked_running_sum, ordered_positions

    index = {"floor": _floor_index, "nearest": _nearest_index}[rule]
    counts = value_counts(df, value, by)
    known = ordered_positions(counts.filter(F.col("v").isNotNull()), [*by, "v"])
    ranked = chunked_running_sum(known, list(by), F.col("n"), "before")
    sizes = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"))
    ranked = ranked.join(sizes, list(by))
    hits = [
        F.max(F.when((F.col("before") <= index(p)) & (index(p) < F.col("before") + F.col("n")), F.col("v"))).alias(f"p{p}")
        for p in ps
    ]
    found = ranked.groupBy(*by).agg(*hits)
    return sizes.join(found, list(by), "left").select(*by, *[F.coalesce(f"p{p}", F.lit(0)).alias(f"p{p}") for p in ps])
