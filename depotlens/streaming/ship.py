"""Continuous conditional decrement in the order of event time.

A source delivers requests in any order up to some delay, so a decision holds
only once no earlier request can arrive.  Both operators hold requests back by
``delay`` and never drop one: what comes later still is decided on arrival and
marked ``late``.

:func:`ship_stream` keeps stock and waiting requests of an item in its state;
event-time timers decide a request, once and finally, as the watermark passes it
by ``delay``.  :func:`start_shipping` hands each micro-batch to the batch
operator, which also splits hot items, and keeps stock and waiting requests in
files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from depotlens.operators.ledger import STOCK_KEY, closing_stock, ship_batch, stock_lookup

_DECISION = (
    "item_id string, warehouse_id string, request_id bigint, quantity bigint, "
    "accepted boolean, stock_after bigint, late boolean"
)
NEVER = -(1 << 62)
COMPACT_EVERY = 20   # micro-batches between two full copies of the stock
#: How far the engine's watermark stays behind the newest event.  It holds no state, it only says which
#: requests still reach the operator to be marked late.
REACH = "3650 days"


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; the session's choice comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Shipping(StatefulProcessor):
    """State of one item: the stock left, and the requests that wait, each at most ``delay`` of event time.

    One timer an item stands at its earliest waiting request.  When it fires, all requests up to the
    horizon are decided in order of time and the timer moves on.  Every call on a state or a timer is a
    round trip to the JVM, so the timer is remembered with the stock and only what changed is written.
    """

    def __init__(self, delay_us: int, reach_us: int) -> None:
        self.ahead_us = reach_us - delay_us  # from the engine's watermark to the horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "quantity bigint, timer bigint")
        self.waiting = handle.getListState("waiting", "at bigint, request_id bigint, quantity bigint")

    def _horizon(self, timers) -> int:
        watermark = timers.getCurrentWatermarkInMs()
        return watermark * 1000 + self.ahead_us if watermark > 0 else NEVER

    def _settled(
        self, key: tuple, state: tuple | None, opening: int, fired: bool, new: list[tuple], late: list[tuple], horizon: int
    ) -> Iterator[pd.DataFrame]:
        """Decides what the horizon has passed, then the late ones; keeps the rest and sets the timer to its first."""
        left, timer = (opening, 0) if state is None else map(int, state)
        known = [] if state is None else [tuple(map(int, r)) for r in self.waiting.get()]
        ready = [r for r in known + new if r[0] <= horizon]
        rest = [r for r in known + new if r[0] > horizon]
        rows = []
        for requests, is_late in ((ready, False), (late, True)):
            for _, request_id, quantity in sorted(requests):
                accepted = 0 < quantity <= left
                left -= quantity if accepted else 0
                rows.append((*key, request_id, quantity, accepted, left, is_late))
        expiry = (min(rest)[0] - self.ahead_us) // 1000 + 1 if rest else 0
        if rest and (new or ready):
            self.waiting.put(rest)
        elif known and not rest:
            self.waiting.clear()
        if expiry != timer:
            if timer and not fired:
                self.handle.deleteTimer(timer)
            if expiry:
                self.handle.registerTimer(expiry)
        if state is None or (left, expiry) != tuple(map(int, state)):
            self.left.update((left, expiry))
        if rows:
            yield pd.DataFrame(
                rows, columns=["item_id", "warehouse_id", "request_id", "quantity", "accepted", "stock_after", "late"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        horizon, opening = self._horizon(timerValues), 0
        new: list[tuple] = []
        for frame in rows:
            if not new:
                opening = int(frame["stock_quantity"].iloc[0])
            new += zip(*(frame[c].astype(int).tolist() for c in ("at", "request_id", "quantity")))
        late = [r for r in new if r[0] <= horizon]
        yield from self._settled(key, self.left.get(), opening, False, [r for r in new if r[0] > horizon], late, horizon)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, self.left.get(), 0, True, [], [], self._horizon(timerValues))

    def close(self) -> None:
        pass


def ship_stream(requests: DataFrame, opening: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Decisions per request in event-time order, as far as requests are no more than ``delay`` out of order.

    Every request is decided once and for good: when an event ``delay`` later than it has been seen anywhere
    in the stream, or on arrival, marked ``late``, if that has happened before.  The state of an item is its
    stock and its requests of the last ``delay``; an item with very many of those belongs to
    :func:`start_shipping`.  The opening stock is read when an item is first seen.  Start the stream inside
    :func:`timer_state`; what waits when the source has ended is in the checkpoint, see :func:`waiting_decisions`.
    """
    spark = requests.sparkSession
    timed = stock_lookup(requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", REACH), opening)
    return timed.withColumn("at", F.unix_micros("ts")).groupBy(*STOCK_KEY).transformWithStateInPandas(
        _Shipping(_micros(spark, delay), _micros(spark, REACH)), _DECISION, "append", "EventTime")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def waiting_decisions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Decisions on the requests that still wait in the checkpoint of a :func:`ship_stream` whose source has ended."""
    key = [F.col(f"key.{c}").alias(c) for c in STOCK_KEY]
    waiting = _state(spark, checkpoint, "waiting").select(*key, F.col("list_element.*")).withColumn("ts", F.timestamp_micros("at"))
    stock = _state(spark, checkpoint, "left").select(*key, F.col("value.quantity"))
    decided = ship_batch(stock, waiting.drop("at"), order=["ts", "request_id"])
    return decided.select(*STOCK_KEY, "request_id", "quantity", "accepted", "stock_after", F.lit(False).alias("late"))


def _micros(spark: SparkSession, delay: str) -> int:
    span = f"TIMESTAMP'2000-01-01 00:00:00' + INTERVAL {delay}"
    start = "TIMESTAMP'2000-01-01 00:00:00'"
    return spark.range(1).select(F.expr(f"unix_micros({span}) - unix_micros({start})")).first()[0]


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def _base_before(batch_id: int) -> int:
    """The batch whose full copy of the stock a later batch starts from; -1: the opening stock."""
    return (batch_id - 1) // COMPACT_EVERY * COMPACT_EVERY if batch_id > COMPACT_EVERY else -1


def current_stock(
    spark: SparkSession, opening: DataFrame, path: str, before_batch: int | None = None, copied: int | None = None
) -> DataFrame:
    """Opening stock overlaid with the newest figure each micro-batch left.

    Reads the last full copy and the batches after it, so the cost does not
    grow with the history.
    """
    base = opening.select(*STOCK_KEY, "quantity", F.lit(-1).cast("bigint").alias("batch_id"))
    written = _written(spark, f"{path}/stock")
    if written is None:  # nothing shipped yet
        return base.drop("batch_id")
    if before_batch is None:
        before_batch = written.agg(F.max("batch_id")).first()[0] + 1
    copied = _base_before(before_batch) if copied is None else copied
    if copied >= 0:
        full = spark.read.parquet(f"{path}/stock_base/upto={copied}")
        base = full.select(*STOCK_KEY, "quantity", F.lit(copied).cast("bigint").alias("batch_id"))
    newer = written.filter((F.col("batch_id") > copied) & (F.col("batch_id") < before_batch)).select(
        *STOCK_KEY, "quantity", F.col("batch_id").cast("bigint"))
    return base.unionByName(newer).groupBy(*STOCK_KEY).agg(
        F.max_by("quantity", "batch_id").alias("quantity")
    )


def _settle(spark: SparkSession, opening: DataFrame, path: str, ready: DataFrame, batch_id: int, options: dict) -> None:
    """Decides requests and writes what this batch decided and left."""
    stock = current_stock(spark, opening, path, before_batch=batch_id)
    decided = f"{path}/decisions/batch_id={batch_id}"
    late_first = ["in_time", "ts", "request_id"]
    ship_batch(stock, ready, order=late_first, **options).withColumn("late", ~F.col("in_time")).drop("in_time").write.mode(
        "overwrite").parquet(decided)
    answers = spark.read.parquet(decided)
    touched = answers.select(*STOCK_KEY).distinct()
    closing_stock(stock.join(touched, list(STOCK_KEY), "left_semi"), answers).select(
        *STOCK_KEY, "quantity"
    ).write.mode("overwrite").parquet(f"{path}/stock/batch_id={batch_id}")
    if batch_id and batch_id % COMPACT_EVERY == 0:
        current_stock(spark, opening, path, batch_id + 1, _base_before(batch_id)).write.mode("overwrite").parquet(
            f"{path}/stock_base/upto={batch_id}")


def start_shipping(
    requests: DataFrame, opening: DataFrame, path: str, checkpoint: str,
    available_now: bool = True, delay: str = "0 seconds", **options,
) -> StreamingQuery:
    """Decides each micro-batch with :func:`ship_batch`, in event-time order across batches.

    A request waits in ``path/waiting`` until one ``delay`` later has been seen;
    :func:`finish_shipping` decides what still waits when the source has ended.
    Everything a batch writes goes to folders named after it, and a batch reads
    only those of earlier ones: repeating a batch after a failure gives the
    same files.
    """
    delay_us = _micros(requests.sparkSession, delay)

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = _written(spark, f"{path}/waiting/batch_id={batch_id - 1}")
        horizons = _written(spark, f"{path}/horizon")
        before = None if horizons is None else horizons.filter(F.col("batch_id") < batch_id).agg(F.max("until")).first()[0]
        before = NEVER if before is None else before
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        every = batch.withColumn("in_time", at > before)
        if waiting is not None:
            every = every.unionByName(waiting.select(*batch.columns).withColumn("in_time", F.lit(True)))
        newest = batch.agg(F.max(at)).first()[0]
        until = before if newest is None else max(before, newest - delay_us)
        spark.createDataFrame([(until,)], "until bigint").write.mode("overwrite").parquet(f"{path}/horizon/batch_id={batch_id}")
        _settle(spark, opening, path, every.filter(~F.col("in_time") | (at <= until)), batch_id, options)
        every.filter(F.col("in_time") & (at > until)).drop("in_time").write.mode("overwrite").parquet(
            f"{path}/waiting/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def finish_shipping(spark: SparkSession, opening: DataFrame, path: str, **options) -> None:
    """Decides the requests that still wait after the last batch; call it once the source has ended."""
    batches = _written(spark, f"{path}/horizon")
    if batches is None:
        return
    last = batches.agg(F.max("batch_id")).first()[0]
    waiting = spark.read.parquet(f"{path}/waiting/batch_id={last}").withColumn("in_time", F.lit(True))
    _settle(spark, opening, path, waiting, last + 1, options)
