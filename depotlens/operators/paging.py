"""Ordered pages by offset or by cursor, totals, and a walk over all capped pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.scalar import decode_token, encode_token
from depotlens.operators.skew import global_rank
from depotlens.schemas import PAGE_SIZE, PRIMARY_KEY

TOP_K_DEPTH = 10_000   # offsets from here on are reached through counted key ranges


def axis_order(axis: str) -> list[str]:
    """The axis with the primary key as tie-break: a total order."""
    return list(dict.fromkeys([axis, *PRIMARY_KEY]))


@dataclass(frozen=True)
class Page:
    """Rows of one page, and the cursor that continues after its last row."""

    rows: DataFrame
    peeked: DataFrame  # the page plus one more row, if any, numbered in order
    order: tuple[str, ...]
    descending: bool
    size: int

    def token_table(self) -> DataFrame:
        """One row: ``next_token``, NULL when nothing remains.

        At most size + 1 rows arrive here; the token comes from the last row of
        a full page that has a successor.
        """
        return self.peeked.agg(self._token().alias("next_token"))

    def _token(self) -> Column:
        """Aggregate over the numbered rows: the cursor after the page."""
        last = F.max(F.when(F.col("_at") == self.size, F.struct(*self.order)))
        return F.when(F.max("_at") > self.size, encode_token(last))

    def with_token(self) -> DataFrame:
        """The rows with ``next_token``, from one top-k of size + 1 rows."""
        columns = [c for c in self.peeked.columns if c != "_at"]
        every = self.peeked.groupBy().agg(
            self._token().alias("next_token"), F.array_sort(F.collect_list(F.struct("_at", *columns))).alias("page")
        )
        page = every.select(F.explode(F.slice("page", 1, self.size)).alias("row"), "next_token")
        return page.select(*[F.col("row")[c].alias(c) for c in columns], "next_token")

    def next_token(self) -> str | None:
        return self.token_table().first()["next_token"]


def after_cursor(order: list[str], values: dict, descending: bool) -> Column:
    """Rows strictly after the cursor in a total order.

    The first comparison alone reaches the Parquet footers and skips files; the
    struct comparison settles ties.
    """
    here, there = F.struct(*order), F.struct(*[F.lit(values[c]).alias(c) for c in order])
    lead, bound = F.col(order[0]), F.lit(values[order[0]])
    return (lead <= bound) & (here < there) if descending else (lead >= bound) & (here > there)


def ordered_page(
    df: DataFrame, axis: str, order: str | None = None, token: str | None = None,
    size: int = PAGE_SIZE,
) -> Page:
    """One page along an axis.  Any order but ``desc`` is ascending."""
    descending = order == "desc"
    columns = axis_order(axis)
    if token:
        df = df.filter(after_cursor(columns, decode_token(token, columns), descending))
    directed = [F.desc(c) if descending else F.asc(c) for c in columns]
    ordered = df.orderBy(*directed)
    # The limit leaves size + 1 rows in one task; they are numbered there.
    number = F.row_number().over(Window.orderBy(*directed))
    peeked = ordered.limit(size + 1).withColumn("_at", number)
    return Page(ordered.limit(size), peeked, tuple(columns), descending, size)


def offset_page(
    df: DataFrame, order: list[str], start: int = 0, size: int = PAGE_SIZE, top_k_depth: int | None = None
) -> DataFrame:
    """Rows start .. start + size in a total order, in that order.

    A top-k keeps start + size rows in each task, which is right for the first
    pages only.  For deeper ones the keys alone are range-partitioned and
    counted; the ranges that hold the page bound the keys that are read, and
    the page is the top of what lies between.
    """
    if start + size <= (TOP_K_DEPTH if top_k_depth is None else top_k_depth):
        return df.orderBy(*order).offset(start).limit(size)
    key = F.struct(*order)
    ranges = df.select(*order).repartitionByRange(*order).groupBy(F.spark_partition_id().alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")
    )
    line = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    held = ranges.withColumn("upto", F.sum("n").over(line)).filter(
        (F.col("upto") > start) & (F.col("upto") - F.col("n") < start + size)
    ).orderBy("upto").collect()
    if not held:
        return df.filter(F.lit(False))

    def literal(place) -> Column:
        types = df.select(*order).schema
        return F.struct(*[F.lit(place[c]).cast(types[c].dataType).alias(c) for c in order])

    inside = df.filter(
        (F.col(order[0]) >= F.lit(held[0]["first"][order[0]])) & (F.col(order[0]) <= F.lit(held[-1]["last"][order[0]]))
        & (key >= literal(held[0]["first"])) & (key <= literal(held[-1]["last"]))
    ) if all(v is not None for v in (held[0]["first"][order[0]], held[-1]["last"][order[0]])) else df.filter(
        (key >= literal(held[0]["first"])) & (key <= literal(held[-1]["last"])))
    return inside.orderBy(*order).offset(start - (held[0]["upto"] - held[0]["n"])).limit(size)


def page_info(df: DataFrame, start: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Exact total, page number from 1, and page count (at least 1)."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        F.lit(start // size + 1).cast("bigint").alias("page_number"),
        F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size)).alias("page_count"),
    )


def capped_walk(df: DataFrame, criteria, size: int = PAGE_SIZE) -> DataFrame:
    """Every page of a capped search in one job: rows read and hits per page.

    Only the order and a hit flag are ranked, and a warehouse is ranked in
    chunks rather than in one task.
    """
    from depotlens.operators.search import all_of, choose_axis

    choice = choose_axis(criteria)
    columns = axis_order(choice.axis)
    marked = df.filter(all_of(choice.on_axis)).select(
        *columns, all_of(list(choice.residual.values())).alias("hit")
    )
    page = (F.floor((F.col("rank") - 1) / size) + 1).alias("page")
    return global_rank(marked, columns).groupBy(page).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if("hit").alias("hits")
    )


def walk_summary(walk: DataFrame) -> DataFrame:
    """Pages in all, pages with hits, and how many pages find every match."""
    return walk.agg(
        F.count(F.lit(1)).alias("pages"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.count_if(F.col("hits") > 0).alias("pages_with_hits"),
        F.coalesce(F.max(F.when(F.col("hits") > 0, F.col("page"))), F.lit(0)).alias("pages_until_all"),
    )


def history(runs: DataFrame, by: str = "started_at", tie: str = "execution_id") -> DataFrame:
    """Runs newest first."""
    return runs.orderBy(F.desc(by), F.desc(tie))
