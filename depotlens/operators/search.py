"""Inventory search in two modes.

*complete*: every criterion on every row; all matches, exact total.
*capped*: one ordered axis is read for a page of rows, and the criteria the axis
does not cover are applied to that page only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.scalar import query_tokens, tokens
from depotlens.operators.paging import Page, ordered_page
from depotlens.schemas import INDEXED_VARIANTS, PAGE_SIZE, VARIANTS

if TYPE_CHECKING:
    from depotlens.sources.views import OrderedView

# The notes a capped search reports.
NOTE_NO_WAREHOUSE = "capped search needs a warehouse: every ordered view is kept per warehouse"
NOTE_NAME = "name substring is applied after the page was read"
NOTE_QUANTITY = "quantity range is applied after the page was read"

_NUMBER = re.compile(r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)")


def _number(text: object) -> float | None:
    if isinstance(text, (int, float)):
        return None if math.isnan(text) else text
    stripped = str(text).strip()
    if not _NUMBER.fullmatch(stripped):
        return None
    return float(stripped.replace("Infinity", "inf"))


@dataclass(frozen=True)
class Criteria:
    """Up to eight optional criteria; absent ones do not restrict."""

    warehouse_id: str | None = None
    item_prefix: str | None = None
    location_prefix: str | None = None
    item_name: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_quantity: float | None = None
    max_quantity: float | None = None

    @classmethod
    def parse(cls, raw: Mapping[str, object]) -> Criteria:
        """From form text: trimmed, blanks dropped, non-numeric bounds dropped."""
        values = {}
        for f in fields(cls):
            text = raw.get(f.name)
            if text is None or str(text).strip() == "":
                continue
            numeric = f.name.startswith(("min_", "max_"))
            values[f.name] = _number(text) if numeric else str(text).strip()
        return cls(**values)

    def conditions(self, mode: str) -> dict[str, Column]:
        """One column per present criterion, keyed by the column it tests."""
        found: dict[str, Column] = {}
        if self.warehouse_id:
            found["warehouse_id"] = F.col("warehouse_id") == self.warehouse_id
        if self.item_prefix:
            found["item_id"] = F.col("item_id").startswith(self.item_prefix)
        if self.location_prefix:
            found["location"] = F.col("location").startswith(self.location_prefix)
        if self.item_name:
            found["item_name"] = (
                F.col("item_name").contains(self.item_name) if mode == "capped"
                else match_any("item_name", self.item_name)
            )
        for column, low, high in (
            ("unit_price", self.min_price, self.max_price),
            ("quantity", self.min_quantity, self.max_quantity),
        ):
            bound = whole_range(column, low, high)
            if bound is not None:
                found[column] = bound
        return found


    def description(self, column: str) -> str:
        """What a capped search did with a criterion after the read."""
        if column == "item_id":
            return f'begins_with(item_id, "{self.item_prefix}")'
        if column == "location":
            return f'begins_with(location, "{self.location_prefix}")'
        if column == "item_name":
            return f'contains(item_name, "{self.item_name}")'
        low, high = (
            (self.min_price, self.max_price) if column == "unit_price"
            else (self.min_quantity, self.max_quantity)
        )
        if low is not None and high is not None:
            return f"{column} BETWEEN {_plain(low)} AND {_plain(high)}"
        return f"{column} >= {_plain(low)}" if low is not None else f"{column} <= {_plain(high)}"


def _plain(number: float) -> str:
    return str(int(number)) if float(number).is_integer() else str(number)


def closed_range(column: str, low: float | None, high: float | None) -> Column | None:
    if low is not None and high is not None:
        return F.col(column).between(low, high)
    if low is not None:
        return F.col(column) >= low
    if high is not None:
        return F.col(column) <= high
    return None


def whole_range(column: str, low: float | None, high: float | None) -> Column | None:
    """:func:`closed_range` on a whole-number column: bounds become whole numbers, so they reach the files."""
    if low is None and high is None:
        return None
    if low == math.inf or high == -math.inf:
        return F.lit(False)
    low = None if low is None or low == -math.inf else math.ceil(low)
    high = None if high is None or high == math.inf else math.floor(high)
    edge = (1 << 63) - 1
    held = [None if b is None else max(min(b, edge), -edge) for b in (low, high)]
    return closed_range(column, *held) if any(b is not None for b in held) else F.col(column).isNotNull()


def match_any(column: str, text: str) -> Column:
    """True when any token of ``text`` is a token of the column; no token, no match.

    A token can only occur where its characters do, so a plain byte search
    comes first and most rows are never cut into tokens.
    """
    wanted = query_tokens(text)
    if not wanted:
        return F.lit(False)
    whole = F.lower(F.col(column))
    near = reduce(lambda a, b: a | b, [whole.contains(t) for t in wanted])
    return near & F.arrays_overlap(tokens(F.col(column)), F.array(*[F.lit(t) for t in wanted]))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def search(df: DataFrame, criteria: Criteria) -> DataFrame:
    """Complete mode: all rows that meet every present criterion."""
    return df.filter(all_of(list(criteria.conditions("complete").values())))


def search_any(df: DataFrame, groups: Sequence[Criteria]) -> DataFrame:
    """Rows that meet at least one group: one scan, where a union would take one per group."""
    met = [all_of(list(c.conditions("complete").values())) for c in groups]
    return df.filter(reduce(lambda a, b: a | b, met))


def get_item(df: DataFrame, warehouse_id: str, item_id: str) -> DataFrame:
    """Point read; an empty result means NOT_FOUND.

    The id reaches the scan, where the Bloom filters of :func:`~depotlens.sources.catalogue.write_layouts`
    exclude the row groups without it.
    """
    return df.filter((F.col("warehouse_id") == warehouse_id) & (F.col("item_id") == item_id))


def get_items(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Many point reads: one row per requested key with a ``found`` flag.

    Stored rows are sorted, never broadcast: a catalogue that is expanded on reading is far larger than Spark
    takes it for, and each executor would hold it whole.
    """
    stored = df.withColumn("found", F.lit(True)).hint("merge")
    return keys.join(stored, ["warehouse_id", "item_id"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


@dataclass(frozen=True)
class AxisChoice:
    """Ordering axis of a capped search, and what is left for after the read."""

    view: str
    axis: str
    on_axis: tuple[Column, ...]
    residual: dict[str, Column]


def choose_axis(criteria: Criteria) -> AxisChoice:
    """Price, else location, else item id; the first one present is the axis."""
    residual = criteria.conditions("capped")
    on_axis = [residual.pop("warehouse_id")]
    for view, column in (("byUnitPrice", "unit_price"), ("byLocation", "location"), ("byWarehouse", "item_id")):
        if column in residual:
            on_axis.append(residual.pop(column))
            return AxisChoice(view, column, tuple(on_axis), residual)
    return AxisChoice("byWarehouse", "item_id", tuple(on_axis), residual)


@dataclass(frozen=True)
class CappedResult:
    rows: DataFrame
    page: Page | None
    view: str
    filters: tuple[str, ...]
    note: str | None


def capped_search(
    df: DataFrame, criteria: Criteria, token: str | None = None, size: int = PAGE_SIZE
) -> CappedResult:
    """Reads one page along one axis, then drops rows that miss the other criteria.

    The limit sits below the residual filter on purpose: a page may come back
    short or empty although matches exist.  The cursor continues after the last
    row *read*.  Without a warehouse nothing can be read.
    """
    if not criteria.warehouse_id:
        return CappedResult(df.filter(F.lit(False)), None, "none", (), NOTE_NO_WAREHOUSE)
    choice = choose_axis(criteria)
    page = ordered_page(df.filter(all_of(choice.on_axis)), choice.axis, token=token, size=size)
    notes = [n for c, n in (("item_name", NOTE_NAME), ("quantity", NOTE_QUANTITY)) if c in choice.residual]
    return CappedResult(
        page.rows.filter(all_of(list(choice.residual.values()))),
        page, choice.view, tuple(criteria.description(c) for c in choice.residual),
        "; ".join(notes) or None,
    )


def capped_search_views(
    views: Mapping[str, OrderedView], criteria: Criteria, token: str | None = None,
    size: int = PAGE_SIZE,
) -> CappedResult:
    """:func:`capped_search` on written ordered views: reads the files of one page only."""
    if not criteria.warehouse_id:
        return capped_search(views["item_id"].rows(), criteria)
    axis = choose_axis(criteria).axis
    prefix = {"location": criteria.location_prefix, "item_id": criteria.item_prefix}.get(axis)
    start = criteria.min_price if axis == "unit_price" else None
    rows = views[axis].slice(criteria.warehouse_id, start, prefix, token=token, size=size)
    return capped_search(rows, criteria, token, size)


def list_inventory(
    df: DataFrame, warehouse_id: str, variant: str, search_by: str | None = None,
    prefix: str | None = None, min_price: float | None = None, max_price: float | None = None,
    order: str | None = None, token: str | None = None, size: int = PAGE_SIZE,
) -> Page:
    """Ordered listing of one warehouse, optionally along one search axis.

    An axis whose arguments are missing falls back to the plain listing; the
    price axis needs both bounds.
    """
    if variant not in VARIANTS:
        raise ValueError("INVALID_TABLE")
    if search_by and variant not in INDEXED_VARIANTS:
        raise ValueError("UNSUPPORTED_SEARCH")
    rows, axis = df.filter(F.col("warehouse_id") == warehouse_id), "item_id"
    if search_by == "itemPrefix" and prefix:
        rows = rows.filter(F.col("item_id").startswith(prefix))
    elif search_by == "location" and prefix:
        rows, axis = rows.filter(F.col("location").startswith(prefix)), "location"
    elif search_by == "unitPrice" and min_price is not None and max_price is not None:
        rows, axis = rows.filter(F.col("unit_price").between(min_price, max_price)), "unit_price"
    return ordered_page(rows, axis, order=order, token=token, size=size)


def list_inventory_views(
    views: Mapping[str, OrderedView], warehouse_id: str, variant: str, search_by: str | None = None,
    prefix: str | None = None, min_price: float | None = None, max_price: float | None = None,
    order: str | None = None, token: str | None = None, size: int = PAGE_SIZE,
) -> Page:
    """:func:`list_inventory` on written ordered views: reads the files of one page only."""
    axis, start, begins = "item_id", None, None
    if search_by == "itemPrefix" and prefix:
        begins = prefix
    elif search_by == "location" and prefix:
        axis, begins = "location", prefix
    elif search_by == "unitPrice" and min_price is not None and max_price is not None:
        axis, start = "unit_price", max_price if order == "desc" else min_price
    rows = views[axis].slice(warehouse_id, start, begins, order, token, size)
    return list_inventory(rows, warehouse_id, variant, search_by, prefix, min_price, max_price, order, token, size)


def compare_modes(df: DataFrame, criteria: Criteria) -> DataFrame:
    """Row-level presence of each match in the complete result and in the capped page."""
    keys = ["warehouse_id", "item_id"]
    complete = search(df, criteria).select(*keys, F.lit(True).alias("in_complete"))
    capped = capped_search(df, criteria).rows.select(*keys, F.lit(True).alias("in_capped"))
    return complete.join(capped, keys, "full_outer").select(
        *keys,
        F.coalesce("in_complete", F.lit(False)).alias("in_complete"),
        F.coalesce("in_capped", F.lit(False)).alias("in_capped"),
    )


def mode_summary(presence: DataFrame) -> DataFrame:
    """Hits per mode, rows in both, and the share of all matches on the capped page."""
    both = F.count_if(F.col("in_complete") & F.col("in_capped"))
    total = F.count_if("in_complete")
    return presence.agg(
        total.alias("complete_hits"),
        F.count_if("in_capped").alias("capped_hits"),
        both.alias("in_both"),
        F.coalesce(F.round(both / F.nullif(total, F.lit(0)), 6), F.lit(0.0)).alias("recall"),
    )


def coverage(probe: DataFrame, pool: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many distinct probe keys occur in the pool, and their share.

    Both sides shrink to distinct keys before they meet, so repeated keys cost
    nothing in the join.
    """
    sides = (
        probe.select(*keys).distinct().withColumn("side", F.lit(1))
        .unionByName(pool.select(*keys).distinct().withColumn("side", F.lit(2)))
    )
    met = sides.groupBy(*keys).agg(
        F.max(F.col("side") == 1).alias("probed"), F.max(F.col("side") == 2).alias("pooled")
    )
    probed, covered = F.count_if("probed"), F.count_if(F.col("probed") & F.col("pooled"))
    return met.agg(
        probed.alias("probe_keys"), covered.alias("covered_keys"),
        F.coalesce(F.round(covered / F.nullif(probed, F.lit(0)), 6), F.lit(0.0)).alias("covered_share"),
    )


def grep_log(df: DataFrame, text: str, regex: str, newest: Sequence[str], n: int = 50) -> DataFrame:
    """Newest ``n`` rows whose text matches the pattern (a top-n report)."""
    return df.filter(F.col(text).rlike(regex)).orderBy(*[F.desc(c) for c in newest]).limit(n)


def relational_search(
    df: DataFrame, contains: Mapping[str, str], ranges: Mapping[str, tuple[float, float]],
    order: Sequence[Column], limit: int, offset: int = 0,
) -> DataFrame:
    """Substring and range conditions on any columns, any order, LIMIT and OFFSET."""
    met = [F.col(c).contains(v) for c, v in contains.items()]
    met += [F.col(c).between(*b) for c, b in ranges.items()]
    return df.filter(all_of(met)).orderBy(*order).offset(offset).limit(limit)
