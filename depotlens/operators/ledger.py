"""Stock ledger: conditional decrement in order, counters, stock from movements."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.scalar import iso_instant
from depotlens.operators.skew import chunked_running_sum, ordered_positions
from depotlens.session import cut_lineage

STOCK_KEY = ("item_id", "warehouse_id")
HOT_ROWS = 10_000_000        # a key with more requests is decided in slices
BROADCAST_KEYS = 100_000     # hot-key tables up to this many rows are broadcast


def stock_lookup(requests: DataFrame, stock: DataFrame, keys: Sequence[str] = STOCK_KEY) -> DataFrame:
    """Each request with the stock of its item; a missing item counts as 0."""
    held = stock.select(*keys, F.col("quantity").alias("stock_quantity"))
    return requests.join(held, list(keys), "left").withColumn(
        "stock_quantity", F.coalesce("stock_quantity", F.lit(0).cast("bigint"))
    )


def ship_batch(
    stock: DataFrame, requests: DataFrame, keys: Sequence[str] = STOCK_KEY,
    order: Sequence[str] = ("ts", "request_id"), hot_rows: int = HOT_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Greedy decrement per key in the given order.

    A request for at least one piece is accepted when the stock covers it and then lowers the stock; a
    rejected one leaves it as it is, so a later, smaller one may still fit.
    Returns the requests with ``accepted`` and ``stock_after``.

    Quantities and stock must be whole numbers or decimals; decimals are decided
    exactly, as whole numbers of the smallest unit.  ``order`` must end in a unique
    column.  Ordinary keys are streamed in order through their task in constant
    memory.  Keys with more than ``hot_rows`` requests are cut into slices that
    many tasks work on (see :func:`_ship_hot`).
    """
    kinds = [frame.schema["quantity"].dataType for frame in (stock, requests)]
    if not all(isinstance(kind, (T.LongType, T.IntegerType, T.DecimalType)) for kind in kinds):
        raise TypeError("quantity must be a whole-number or decimal column")
    scale = max(kind.scale if isinstance(kind, T.DecimalType) else 0 for kind in kinds)
    if any(isinstance(kind, T.DecimalType) for kind in kinds):
        return _ship_decimals(stock, requests, scale, keys, order, hot_rows, partitions)
    keys, order = list(keys), list(order)
    requests = requests.withColumn("quantity", F.col("quantity").cast("bigint"))
    stock = stock.select(*keys, F.col("quantity").cast("bigint").alias("quantity"))
    hot = cut_lineage(
        requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > hot_rows).select(*keys)
    )
    n_hot = hot.count()
    if n_hot == 0:
        return _ship_streamed(stock, requests, keys, order)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    cold_rows = requests.join(hot, keys, "left_anti")
    hot_rows_df = requests.join(hot, keys, "left_semi")
    hot_stock = hot.join(stock, keys, "left").select(
        *keys, F.coalesce("quantity", F.lit(0).cast("bigint")).alias("quantity")
    )
    decided = _ship_hot(hot_stock, hot_rows_df, keys, order, n_hot, partitions)
    both = _ship_streamed(stock, cold_rows, keys, order).unionByName(decided)
    return both.select(*requests.columns, "accepted", "stock_after")


def _ship_decimals(
    stock: DataFrame, requests: DataFrame, scale: int, keys: Sequence[str], order: Sequence[str], hot_rows: int,
    partitions: int | None,
) -> DataFrame:
    """:func:`ship_batch` in whole units of 10 to the power of -``scale``."""
    unit = 10**scale
    kind = f"decimal(38,{scale})"

    def units(frame: DataFrame) -> DataFrame:
        return frame.withColumn("quantity", (F.col("quantity").cast(kind) * F.lit(unit)).cast("bigint"))

    decided = ship_batch(units(stock), units(requests), keys, order, hot_rows, partitions)
    back = {c: (F.col(c).cast("decimal(20,0)") / F.lit(unit)).cast(f"decimal({20 + scale},{scale})") for c in ("quantity", "stock_after")}
    return decided.withColumns(back)


def _ship_streamed(stock: DataFrame, requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One shuffle: each key's stock row travels with its requests and sorts first."""
    marked = requests.withColumn("_is_request", F.lit(True))
    opening = stock.select(
        *[F.col(c) if c in keys or c == "quantity" else F.lit(None).cast(requests.schema[c].dataType).alias(c)
          for c in requests.columns],
        F.lit(False).alias("_is_request"),
    )
    placed = marked.unionByName(opening).repartition(*keys).sortWithinPartitions(
        *keys, "_is_request", *order
    )
    schema = T.StructType([
        *requests.schema.fields,
        T.StructField("accepted", T.BooleanType()), T.StructField("stock_after", T.LongType()),
    ])
    return placed.mapInArrow(_fold_batches(keys), schema)


def _fold_batches(keys: list[str]):
    """Arrow batches in key order; only the current key and its stock are carried over."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            starts = np.ones(batch.num_rows, dtype=bool)
            starts[0] = [column[k][0].as_py() for k in keys] != current
            starts[1:] = False
            for k in keys:
                differs = pc.fill_null(pc.not_equal(column[k][1:], column[k][:-1]), True)
                starts[1:] |= differs.to_numpy(zero_copy_only=False)
            current = [column[k][-1].as_py() for k in keys]
            is_request = column.pop("_is_request")
            steps = zip(
                starts.tolist(), is_request.to_numpy(zero_copy_only=False).tolist(),
                pc.fill_null(column["quantity"], 0).to_numpy().tolist(),
            )
            accepted, after = [], []
            for new_key, request, quantity in steps:
                if new_key:
                    left = 0
                fits = request and 0 < quantity <= left
                if fits:
                    left -= quantity
                elif not request:
                    left = quantity
                accepted.append(fits)
                after.append(left)
            decided = pa.RecordBatch.from_arrays(
                [*column.values(), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())],
                names=[*column, "accepted", "stock_after"],
            )
            yield decided.filter(is_request)

    return fold


def _ship_hot(
    stock: DataFrame, requests: DataFrame, keys: list[str], order: list[str], n_keys: int,
    partitions: int | None,
) -> DataFrame:
    """The same greedy rule for keys too large for one task.

    Let ``half`` be the largest power of two up to the stock.  While the stock is
    at least ``half``, every request below ``half`` fits, so those form a plain
    running sum.  A request of ``half`` or more that fits takes the stock below
    ``half``.  So each round is one running sum, cut at its first row that takes
    the stock below ``half``, and the number of rounds is at most the bit length
    of the largest stock.

    A round adds up each chunk where it lies; only chunks that may hold the cut
    are sorted.  Between rounds only the state of each key moves.
    """
    placed = ordered_positions(requests, [*keys, *order], partitions)
    slim = placed.select(*keys, "position", "chunk", "quantity")
    end = F.lit((1 << 63) - 1)

    def small(frame: DataFrame) -> DataFrame:
        # Rows: at most one per hot key and one more per chunk.
        return F.broadcast(frame) if n_keys <= BROADCAST_KEYS else frame

    state = cut_lineage(stock.select(
        *keys, F.col("quantity").alias("left"), F.lit(-1).cast("bigint").alias("from_position")
    ).filter(F.col("left") > 0))
    rounds: list[DataFrame] = []
    while not state.isEmpty():
        live_state = state.withColumn("half", F.expr("shiftleft(1L, length(bin(left)) - 1)"))
        live = slim.join(small(live_state), keys).filter(
            (F.col("position") > F.col("from_position")) & F.col("quantity").between(1, F.col("left"))
        )
        cut = _first_cut(live, keys, small)
        step = cut_lineage(live_state.join(small(cut), keys, "left"))
        rounds.append(step.select(
            *keys, "from_position", "half",
            F.coalesce("cut.position", end).alias("to_position"),
        ))
        state = step.filter(F.col("cut.left") > 0).select(
            *keys, F.col("cut.left").alias("left"), F.col("cut.position").alias("from_position")
        )

    if rounds:
        steps = rounds[0]
        for more in rounds[1:]:
            steps = steps.unionByName(more)
        # At most one entry per bit of the stock for each key.
        steps = steps.groupBy(*keys).agg(
            F.collect_list(F.struct("from_position", "to_position", "half")).alias("steps")
        )
        opening = stock.select(*keys, F.col("quantity").alias("opening"))
        known = opening.join(steps, keys, "left")
    else:
        known = stock.select(*keys, F.col("quantity").alias("opening")).withColumn(
            "steps", F.lit(None).cast("array<struct<from_position:bigint,to_position:bigint,half:bigint>>")
        )
    here = F.col("position")
    met = F.exists(
        F.coalesce("steps", F.array()),
        lambda s: (s["from_position"] < here) & (here <= s["to_position"])
        & ((F.col("quantity") < s["half"]) | (here == s["to_position"])),
    ) & (F.col("quantity") > 0)
    decided = placed.join(small(known), keys).withColumn(
        "accepted", F.coalesce(met, F.lit(False))
    )
    taken = F.when(F.col("accepted"), F.col("quantity")).otherwise(F.lit(0))
    return chunked_running_sum(decided, keys, taken, "spent").withColumn(
        "stock_after", F.col("opening") - F.col("spent") - taken
    ).select(*requests.columns, "accepted", "stock_after")


def _first_cut(live: DataFrame, keys: list[str], small) -> DataFrame:
    """Per key the first position that takes the stock below ``half``, and the stock left there."""
    quantity, half = F.col("quantity"), F.col("half")
    freely = quantity < half
    chunks = live.groupBy(*keys, "chunk", "left", "half").agg(
        F.coalesce(F.sum(F.when(freely, quantity)), F.lit(0)).alias("sum_free"),
        F.min(F.when(~freely, quantity)).alias("least_large"),
    )
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    at_start = F.col("left") - F.coalesce(F.sum("sum_free").over(earlier), F.lit(0))
    at_end = F.col("at_start") - F.col("sum_free")
    crosses = at_end < half
    # Figures after the true cut are off, but the first chunk that must hold a
    # cut is never before it, and the chunk of the true cut is always a "may".
    judged = chunks.withColumn("at_start", at_start).select(
        *keys, "chunk", "at_start",
        (crosses | F.coalesce(F.col("least_large") <= F.col("at_start"), F.lit(False))).alias("may"),
        F.min(F.when(
            crosses | F.coalesce(F.col("least_large") <= at_end, F.lit(False)), F.col("chunk")
        )).over(of_key).alias("must_chunk"),
    )
    suspects = judged.filter(
        F.col("may") & (F.col("must_chunk").isNull() | (F.col("chunk") <= F.col("must_chunk")))
    ).select(*keys, "chunk", "at_start")
    inside = Window.partitionBy(*keys, "chunk").orderBy("position").rowsBetween(
        Window.unboundedPreceding, -1
    )
    now = F.col("at_start") - F.coalesce(
        F.sum(F.when(freely, quantity).otherwise(0)).over(inside), F.lit(0)
    )
    walked = live.join(small(suspects), [*keys, "chunk"]).withColumn("now", now)
    below = F.when(freely, F.col("now") - quantity < half).otherwise(quantity <= F.col("now"))
    return walked.filter(below).groupBy(*keys).agg(
        F.min(F.struct("position", (F.col("now") - quantity).alias("left"))).alias("cut")
    )


def ship_responses(decided: DataFrame) -> DataFrame:
    """Answer of each request: new quantity and time, or the shortage with its message."""
    short = ~F.col("accepted")
    return decided.withColumns({
        "last_updated": F.when(F.col("accepted"), iso_instant(F.col("ts"))),
        "code": F.when(short, "INSUFFICIENT_STOCK"),
        "message": F.when(short, F.concat(
            F.lit("Insufficient stock. Current: "), F.col("stock_after").cast("string"),
            F.lit(", Requested: "), F.col("quantity").cast("string"),
        )),
    })


def closing_stock(stock: DataFrame, decided: DataFrame, keys: Sequence[str] = STOCK_KEY) -> DataFrame:
    """Stock after the batch: accepted pieces are added up per key map-side."""
    taken = decided.groupBy(*keys).agg(
        F.sum(F.when(F.col("accepted"), F.col("quantity")).otherwise(0)).alias("taken"),
        F.max(F.when(F.col("accepted"), F.col("ts"))).alias("last_shipped"),
    )
    return stock.join(taken, list(keys), "left").select(
        *keys, (F.col("quantity") - F.coalesce("taken", F.lit(0))).alias("quantity"), "last_shipped"
    )


def bump(target: DataFrame, events: DataFrame, keys: Sequence[str], counter: str = "counter") -> DataFrame:
    """Adds one per event to a counter without condition; unknown keys start at 0."""
    base = target.select(*keys, F.col(counter).cast("bigint").alias("n"))
    added = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return base.unionByName(added).groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(counter)
    )


def stock_from_movements(movements: DataFrame) -> DataFrame:
    """Stock level as the sum of signed movements."""
    q = F.col("signed_quantity")
    return movements.groupBy("warehouse_id", "item_id").agg(
        F.sum(q).alias("stock_quantity"),
        F.sum(F.when(q > 0, q).otherwise(0)).alias("received"),
        F.sum(F.when(q < 0, -q).otherwise(0)).alias("shipped"),
        F.count(F.lit(1)).alias("movements"),
    )


def running_balance(movements: DataFrame, by: Sequence[str] = ("warehouse_id",), unit: str = "month") -> DataFrame:
    """Balance at the end of each period.

    Movements are added up per period first; a group then holds one row per
    period of the calendar, whatever the number of movements.
    """
    period = F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("period")
    per = movements.groupBy(*by, period).agg(F.sum("signed_quantity").alias("net"))
    upto = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("balance", F.sum("net").over(upto))


def movement_log(
    movements: DataFrame, item_prefix: str | None = None, since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Single movements of items and a period, newest first; the filters reach the scan."""
    rows = movements
    if item_prefix:
        rows = rows.filter(F.col("item_id").startswith(item_prefix))
    if since:
        rows = rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.filter(F.col("ts") < F.lit(until).cast("timestamp"))
    return rows.orderBy(F.desc("ts"), "warehouse_id", "item_id")


def movement_history(movements: DataFrame, unit: str = "month", **chosen: str | None) -> DataFrame:
    """Movements added up per item, period and type; arguments as for :func:`movement_log`."""
    period = F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM").alias("period")
    return movement_log(movements, **chosen).groupBy("item_id", period, "type").agg(
        F.count(F.lit(1)).alias("movements"), F.sum("signed_quantity").alias("net_quantity")
    )


def by_lot(stock: DataFrame, lot: str | None = None) -> DataFrame:
    """Pieces and items per lot and warehouse."""
    rows = stock.filter(F.col("lot_number") == lot) if lot else stock
    return rows.groupBy("lot_number", "warehouse_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity")
    )


def low_stock(stock: DataFrame, threshold: int, quantity: str = "quantity") -> DataFrame:
    """Items at or below the threshold; ``stock_out`` marks empty ones."""
    held: Column = F.col(quantity)
    return stock.filter(held <= threshold).withColumn("stock_out", held <= 0)


def stocktake(counted: DataFrame, movements: DataFrame) -> DataFrame:
    """Counted stock against the ledger, both sides kept, with the variance."""
    zero = F.lit(0).cast("bigint")
    keys = ["warehouse_id", "item_id"]
    found = counted.select(*keys, F.col("quantity").alias("counted_quantity"))
    booked = movements.groupBy(*keys).agg(F.sum("signed_quantity").alias("ledger_quantity"))
    both = found.join(booked, keys, "full_outer")
    return both.select(
        *keys,
        F.coalesce("counted_quantity", zero).alias("counted_quantity"),
        F.coalesce("ledger_quantity", zero).alias("ledger_quantity"),
        (F.coalesce("counted_quantity", zero) - F.coalesce("ledger_quantity", zero)).alias("variance"),
        F.when(F.col("ledger_quantity").isNull(), "not in ledger")
        .when(F.col("counted_quantity").isNull(), "not counted").otherwise("both").alias("presence"),
    )
