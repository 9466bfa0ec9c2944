"""Change feeds: versioned apply, bootstrap, replica on files, lag and lateness.

A change row holds ``op`` (index or delete), ``version``, ``event_ts``,
``arrival_ts``, the key columns and old/new values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from depotlens.streaming.manifest import Manifest, query_id

KEYS = ("item_id", "warehouse_id")
VALUES = ("new_quantity",)
#: Runs of one level that are merged into one of the next.
FANOUT = 8
_RETENTION = "retention"


def _ranked(changes: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Changes as (keys, row, rank).  Of equal versions the first arrival ranks highest."""
    first = -F.unix_micros(F.col("arrival_ts").cast("timestamp"))
    return changes.select(
        *keys,
        F.struct("version", (F.col("op") == "delete").alias("deleted"), *values).alias("row"),
        F.struct(F.col("version"), F.lit(0).alias("held"), first.alias("first")).alias("rank"),
    )


def _winners(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``max_by`` merges map-side: a key with very many changes is reduced before
    the shuffle and never sorted in one task."""
    return ranked.groupBy(*keys).agg(F.max_by("row", "rank").alias("row")).select(*keys, "row.*")


def net_changes(
    changes: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = VALUES
) -> DataFrame:
    """The winning change per key, deletions kept as tombstones."""
    return _winners(_ranked(changes, keys, values), keys)


def apply_changes(
    target: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS,
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """Target after the changes: per key the highest version, older arrivals ignored.

    Target rows carry ``version`` and ``deleted``.  Tombstones stay in the
    result, so an older write that arrives later cannot bring a row back.  On
    equal versions the target row stays.  One shuffle, no join.
    """
    held = target.select(
        *keys, F.struct("version", "deleted", *values).alias("row"),
        F.struct(F.col("version"), F.lit(1).alias("held"), F.lit(0).cast("bigint").alias("first")).alias("rank"),
    )
    return _winners(held.unionByName(_ranked(changes, keys, values)), keys)


def live_rows(target: DataFrame) -> DataFrame:
    return target.filter(~F.col("deleted")).drop("deleted")


def bootstrap(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str] = KEYS,
    values: Sequence[str] = VALUES,
) -> DataFrame:
    """Snapshot rows rank below every change; overlap is harmless."""
    base = snapshot.select(
        *keys, F.lit(-1).cast("bigint").alias("version"), F.lit(False).alias("deleted"), *values
    )
    return apply_changes(base, changes, keys, values)


def _micros(spark: SparkSession, span: str | None) -> int | None:
    if span is None:
        return None
    start = "TIMESTAMP'2000-01-01 00:00:00'"
    return spark.range(1).select(F.expr(f"unix_micros({start} + INTERVAL {span}) - unix_micros({start})")).first()[0]


def _run(spark: SparkSession, path: str, runs: list[dict], schema: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{path}/{r['folder']}" for r in runs])


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The winning row per key; on equal versions the earlier delivery stays."""
    fields = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct(F.col("version"), -F.col("delivery"))).alias("r")).select(*keys, "r.*")


def _levelled(
    spark: SparkSession, path: str, content: dict, keys: Sequence[str], horizon_us: int | None, whole: bool = False
) -> dict:
    """``content`` with full levels merged: at most ``FANOUT`` runs on each of two levels and one base stay."""
    version, runs = content["version"], content["runs"]
    for level in (0, 1):
        here = [r for r in runs if r["level"] == level]
        if len(here) <= FANOUT and not (whole and runs):
            continue
        last = level == 1 or whole
        merging = runs if last else here
        rows = _merged(_run(spark, path, merging, content["schema"]), keys)
        if last and horizon_us is not None and content["clock_us"] is not None:
            expired = F.col("deleted") & (F.col("event_us") <= content["clock_us"] - horizon_us)
            rows = rows.filter(~F.coalesce(expired, F.lit(False)))
        folder = f"data/{version:012d}-level{2 if last else 1}"
        rows.write.mode("overwrite").parquet(f"{path}/{folder}")
        runs = [r for r in runs if r not in merging] + [{"folder": folder, "level": 2 if last else 1}]
        if last:
            break
    return {**content, "runs": runs}


def _beyond(batch: DataFrame, clock_us: int | None, horizon_us: int | None) -> Column:
    """Whether a change is older than the horizon of what was delivered in earlier batches."""
    if clock_us is None or horizon_us is None:
        return F.lit(False)
    return F.coalesce(F.unix_micros(F.col("event_ts").cast("timestamp")) <= clock_us - horizon_us, F.lit(False))


def _advance(state: dict | None, spark: SparkSession, batch_id: int) -> dict | None:
    """The next version's frame, or None if this batch of this stream has been published."""
    state = state or {"version": -1, "runs": [], "applied": {}, "clock_us": None, "schema": None}
    stream = query_id(spark)
    if state["applied"].get(stream, -1) >= batch_id:
        return None
    return {**state, "version": state["version"] + 1, "applied": {**state["applied"], stream: batch_id}}


def _later(clock_us: int | None, new: int | None) -> int | None:
    return new if clock_us is None else clock_us if new is None else max(clock_us, new)


def start_replication(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = KEYS,
    values: Sequence[str] = VALUES, available_now: bool = True, horizon: str | None = None,
) -> StreamingQuery:
    """Follows a change stream into the replica at ``path``.

    A micro-batch writes its net changes as a run, merges levels that are full and publishes one manifest
    (:mod:`depotlens.streaming.manifest`): a batch that is repeated after a failure finds its version published
    or writes it again.  Readers and the next batch go on from the newest version.  A read never opens more
    than ``2 * FANOUT + 1`` runs, however many batches there were, and every row is rewritten once a level and
    once in ``FANOUT ** 2`` batches.

    ``horizon`` is how far behind the newest delivered event a change may be.  Tombstones that old leave
    when the base is merged; changes that old, which could bring such a row back, are kept apart under
    ``path/late`` and counted (:func:`replica_report`).  Without it nothing expires and nothing is late.
    """
    horizon_us = _micros(changes.sparkSession, horizon)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = Manifest(spark, path)
        before = manifest.read()
        content = _advance(before, spark, batch_id)
        if content is None:
            return
        version, late = content["version"], _beyond(batch, (before or {}).get("clock_us"), horizon_us)
        batch = batch.withColumn("event_us", F.unix_micros(F.col("event_ts").cast("timestamp")))
        net = net_changes(batch.filter(~late), keys, (*values, "event_us")).withColumn("delivery", F.lit(version).cast("bigint"))
        folder = f"data/{version:012d}-delta"
        net.write.mode("overwrite").parquet(f"{path}/{folder}")
        content["schema"] = net.schema.json()
        run = _run(spark, path, [{"folder": folder}], content["schema"])
        newest = run.agg(F.max("event_us")).first()[0]
        content["clock_us"] = _later(content["clock_us"], newest)
        if horizon_us is not None:
            kept_apart = f"{path}/late/version={version:012d}"
            batch.filter(late).drop("event_us").write.mode("overwrite").parquet(kept_apart)
            content["late"] = content.get("late", 0) + spark.read.schema(batch.drop("event_us").schema).parquet(kept_apart).count()
        content["runs"] = [*content["runs"], {"folder": folder, "level": 0}]
        manifest.publish(_levelled(spark, path, content, keys, horizon_us))
        manifest.vacuum()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_replica(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Current state with tombstones; on equal versions the earlier batch stays."""
    content = Manifest(spark, path).read()
    if content is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return _merged(_run(spark, path, content["runs"], content["schema"]), keys).drop("event_us", "delivery")


def compact_replica(spark: SparkSession, path: str, horizon: str | None = None, keys: Sequence[str] = KEYS) -> None:
    """Merges all runs into one base and publishes it; the stream goes on from it when it is started again.

    The stream merges by itself while it runs; this is for a replica that only readers use for a while.
    """
    manifest = Manifest(spark, path)
    content = manifest.read()
    if content is None:
        return
    manifest.publish(_levelled(
        spark, path, {**content, "version": content["version"] + 1}, keys, _micros(spark, horizon), whole=True))
    manifest.vacuum()


def replica_report(spark: SparkSession, path: str) -> dict:
    """Version, runs by level, newest event and late changes of a replica, from its manifest alone."""
    content = Manifest(spark, path).read()
    levels = [sum(r["level"] == level for r in content["runs"]) for level in (0, 1, 2)]
    return {"version": content["version"], "levels": levels, "clock_us": content["clock_us"], "late": content.get("late", 0)}


def mark_late(changes: DataFrame, hours: int = 24) -> DataFrame:
    """``late`` marks changes that arrived after the feed's retention horizon."""
    return changes.withColumn(
        "late", F.col("arrival_ts") - F.col("event_ts") > F.make_dt_interval(F.lit(0), F.lit(hours))
    )


def late_changes(changes: DataFrame, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(in time, quarantine).  Works on tables and on streams."""
    marked = mark_late(changes, hours)
    return marked.filter(~F.col("late")).drop("late"), marked.filter("late").drop("late")


class RetentionCounts(StreamingQueryListener):
    """What the streams of :func:`start_retention` have seen: rows, late rows, rows behind the watermark and rows of state.

    Register it with ``spark.streams.addListener`` before the streams are started.
    """

    def __init__(self) -> None:
        self.rows = self.late = self.behind = 0
        self.state_rows: list[int] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(_RETENTION)
        if seen is not None and progress.numInputRows:
            self.rows += seen["rows"]
            self.late += seen["late"]
        for operator in progress.stateOperators:
            self.behind += operator.numRowsDroppedByWatermark
            self.state_rows.append(operator.numRowsTotal)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_retention(
    changes: DataFrame, path: str, checkpoint: str, hours: int = 24, keys: Sequence[str] = KEYS,
    available_now: bool = True,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Splits a change stream into ``path/in_time`` and ``path/quarantine``, each change once.

    A change is late if it arrives more than ``hours`` after it happened, as in :func:`late_changes`.  The
    other side loses redelivered changes; their identities are state that a watermark bounds: it stays two
    times ``hours`` behind the newest change, so a feed may be delivered out of order by ``hours`` before a
    change falls behind it.  :class:`RetentionCounts` tells what was seen on every side.
    """
    marked = mark_late(changes, hours)

    def into(name: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")

        return write

    seen = marked.observe(_RETENTION, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))
    once = seen.filter(~F.col("late")).drop("late").withWatermark("event_ts", f"{2 * hours} hours").dropDuplicatesWithinWatermark(
        [*keys, "version"])
    started = []
    for name, rows in (("in_time", once), ("quarantine", marked.filter("late").drop("late"))):
        writer = rows.writeStream.foreachBatch(into(name)).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append((writer.trigger(availableNow=True) if available_now else writer).start())
    return started[0], started[1]


def lateness_report(changes: DataFrame, hours: int = 24) -> DataFrame:
    day = F.date_format("event_ts", "yyyy-MM-dd").alias("day")
    return mark_late(changes, hours).groupBy(day).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if("late").alias("late")
    )


def sync_lag(changes: DataFrame, unit: str = "1 day") -> DataFrame:
    """Average and largest delay from change to arrival, per window of event time."""
    delay = F.timestamp_diff("SECOND", F.col("event_ts"), F.col("arrival_ts"))
    return changes.groupBy(F.window("event_ts", unit).alias("w")).agg(
        F.count(F.lit(1)).alias("changes"),
        F.round(F.avg(delay), 6).alias("avg_lag_seconds"),
        F.max(delay).alias("max_lag_seconds"),
    ).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "changes", "avg_lag_seconds", "max_lag_seconds",
    )


def running_totals(
    changes: DataFrame, by: Sequence[str] = ("warehouse_id",), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Item and quantity totals from old and new images: a sum of signed differences.

    The feed delivers at least once, so a version of a key counts once.
    """
    old, new = F.col("old_quantity"), F.col("new_quantity")
    once = changes.dropDuplicates(list(dict.fromkeys([*keys, "version"])))
    return once.groupBy(*by).agg(
        F.sum(new.isNotNull().cast("bigint") - old.isNotNull().cast("bigint")).alias("items"),
        F.sum(F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).alias("quantity"),
    )


def start_totals(
    changes: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("warehouse_id",),
    keys: Sequence[str] = KEYS, available_now: bool = True, horizon: str | None = None,
) -> StreamingQuery:
    """Keeps :func:`running_totals` of a change stream up to date at ``path``.

    Every micro-batch publishes one version: the totals before it plus the signed differences of the changes
    it delivers first.  The feed delivers at least once, so a change meets the identities (keys and version)
    of the changes that were counted and are no older than ``horizon``; identities are kept in runs that are
    merged by level, where those beyond the horizon are forgotten.  A change that is older than the horizon when
    it arrives can't be told from a redelivery any more: it is kept apart under ``path/late`` and counted, not
    added.  Without a horizon all identities stay.  Unlike the engine's own de-duplication this survives a
    lost checkpoint, and no row is dropped unseen: rows = counted + repeated + late
    (:func:`totals_report`).
    """
    horizon_us = _micros(changes.sparkSession, horizon)
    identity = list(dict.fromkeys([*keys, "version"]))
    sums = ["items", "quantity"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        manifest = Manifest(spark, path)
        before = manifest.read()
        content = _advance(before, spark, batch_id)
        if content is None:
            return
        version, clock_us = content["version"], (before or {}).get("clock_us")
        columns = list(dict.fromkeys([*identity, *by, "old_quantity", "new_quantity"]))
        rows = batch.select(
            *columns, "event_ts", _beyond(batch, clock_us, horizon_us).alias("late"))
        late = f"{path}/late/version={version:012d}"
        if horizon_us is not None:
            rows.filter("late").drop("late").write.mode("overwrite").parquet(late)
        timed = rows.filter("NOT late").withColumn("event_us", F.unix_micros(F.col("event_ts").cast("timestamp")))
        fields = [c for c in (*columns, "event_us") if c not in identity]
        once = timed.groupBy(*identity).agg(
            F.any_value(F.struct(*fields)).alias("r"), F.count(F.lit(1)).alias("delivered")).select(*identity, "r.*", "delivered")
        if content["runs"]:
            known = _run(spark, path, content["runs"], content["schema"]).select(*identity, F.lit(True).alias("known")).distinct()
            once = once.join(known, identity, "left")
        else:
            once = once.withColumn("known", F.lit(None).cast("boolean"))
        folder = f"data/{version:012d}-delta"
        once.withColumn("delivery", F.lit(version).cast("bigint")).withColumn("deleted", F.lit(True)).write.mode(
            "overwrite").parquet(f"{path}/{folder}-batch")
        stored = spark.read.parquet(f"{path}/{folder}-batch")
        new = stored.filter("known IS NULL")
        counts = stored.agg(
            F.coalesce(F.sum("delivered"), F.lit(0)).alias("rows"), F.count_if(F.col("known").isNull()).alias("counted"),
            F.max("event_us").alias("newest")).first()
        ids = new.select(*identity, "event_us", "delivery", "deleted")
        ids.write.mode("overwrite").parquet(f"{path}/{folder}")
        delta = running_totals(new, by, keys)
        totals = f"data/{version:012d}-totals"
        if content.get("totals"):
            old = spark.read.parquet(f"{path}/{content['totals']}")
            delta = old.unionByName(delta).groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in sums])
        delta.write.mode("overwrite").parquet(f"{path}/{totals}")
        n_late = spark.read.parquet(late).count() if horizon_us is not None else 0
        report = content.get("report", {"rows": 0, "counted": 0, "repeated": 0, "late": 0})
        content |= {
            "schema": ids.schema.json(), "totals": totals, "clock_us": _later(clock_us, counts["newest"]),
            "runs": [*content["runs"], {"folder": folder, "level": 0}],
            "report": {"rows": report["rows"] + counts["rows"] + n_late, "counted": report["counted"] + counts["counted"],
                       "repeated": report["repeated"] + counts["rows"] - counts["counted"], "late": report["late"] + n_late},
        }
        content = _levelled(spark, path, content, identity, horizon_us)
        manifest.publish(content)
        manifest.vacuum()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest version: one small table, whatever was delivered before."""
    return spark.read.parquet(f"{path}/{Manifest(spark, path).read()['totals']}")


def totals_report(spark: SparkSession, path: str) -> dict:
    """Rows delivered, counted, repeated and late so far."""
    return Manifest(spark, path).read()["report"]
