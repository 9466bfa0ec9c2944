import os
import random
import re
import time
from datetime import datetime, timedelta
from pathlib import Path
from uuid import uuid4

import pandas as pd
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from depotlens.operators import ledger
from depotlens.plans import ORACLES, QUERIES
from depotlens.schemas import CHANGE
from depotlens.sources.catalogue import read_changes
from depotlens.streaming import cdc, live, manifest, ship

T0 = datetime(2026, 1, 1)


@pytest.fixture()
def folder(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid4().hex[:8]}")


def feed(seed=3, n=400, keys=7):
    rng = random.Random(seed)
    rows = [
        ("delete" if rng.random() < .2 else "index", v, T0 + timedelta(minutes=v),
         T0 + timedelta(minutes=v, hours=rng.randrange(30)), f"I{0 if rng.random() < .4 else rng.randrange(keys)}",
         "W", None, rng.randrange(100))
        for v in range(n)
    ]
    rng.shuffle(rows)
    return rows


def newest(rows):
    best = {}
    for op, version, _, _, item, house, _, value in rows:
        if (item, house) not in best or version > best[(item, house)][1]:
            best[(item, house)] = (op, version, value)
    return {k: (v, q) for k, (op, v, q) in best.items() if op == "index"}


def state(df):
    return {(r["item_id"], r["warehouse_id"]): (r["version"], r["new_quantity"]) for r in df.collect()}


def empty_target(spark):
    return spark.createDataFrame([], "item_id string, warehouse_id string, version long, deleted boolean, new_quantity long")


def test_arrival_order_does_not_matter(spark):
    want = newest(feed())
    for seed in (1, 2):
        rows = feed()
        random.Random(seed).shuffle(rows)
        target = empty_target(spark)
        for part in (rows[:150], rows[150:160], rows[160:]):
            target = cdc.apply_changes(target, spark.createDataFrame(part, CHANGE))
        assert state(cdc.live_rows(target)) == want


def test_tombstone_keeps_older_writes_out_and_equal_versions_keep_the_first(spark):
    def change(op, version, value, hours):
        return (op, version, T0, T0 + timedelta(hours=hours), "A", "W", None, value)

    target = cdc.apply_changes(empty_target(spark), spark.createDataFrame([change("delete", 5, None, 0)], CHANGE))
    late = spark.createDataFrame([change("index", 4, 1, 1)], CHANGE)
    assert cdc.live_rows(cdc.apply_changes(target, late)).count() == 0
    twice = spark.createDataFrame([change("index", 6, 22, 3), change("index", 6, 11, 2)], CHANGE)
    target = cdc.apply_changes(target, twice)
    assert state(target)[("A", "W")] == (6, 11)
    again = spark.createDataFrame([change("index", 6, 33, 4)], CHANGE)
    assert state(cdc.apply_changes(target, again))[("A", "W")] == (6, 11)


def test_bootstrap_ranks_snapshot_below_changes(spark):
    snapshot = spark.createDataFrame([("A", "W", 1), ("B", "W", 2)], "item_id string, warehouse_id string, new_quantity long")
    changes = spark.createDataFrame([("index", 0, T0, T0, "A", "W", 1, 9), ("index", 1, T0, T0, "C", "W", None, 3)], CHANGE)
    assert state(cdc.live_rows(cdc.bootstrap(snapshot, changes))) == {("A", "W"): (0, 9), ("B", "W"): (-1, 2), ("C", "W"): (1, 3)}


def write_files(spark, rows, schema, path, files, order=None):
    for i in range(files):
        part = rows[i::files] if order is None else order(rows, i, files)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)


def test_stream_replica_equals_batch_and_survives_a_repeated_batch(spark, folder):
    rows, source, replica, mark = feed(), folder("in"), folder("replica"), folder("mark")
    write_files(spark, rows, CHANGE, source, 4)
    stream = read_changes(spark, source, max_files_per_trigger=1)
    cdc.start_replication(stream, replica, mark).awaitTermination()
    assert state(cdc.live_rows(cdc.read_replica(spark, replica))) == newest(rows)
    # A second start reads nothing new; a fresh checkpoint repeats every batch onto the same folders.
    cdc.start_replication(read_changes(spark, source, max_files_per_trigger=1), replica, mark).awaitTermination()
    cdc.start_replication(
        read_changes(spark, source, max_files_per_trigger=1), replica, folder("mark2")).awaitTermination()
    assert state(cdc.live_rows(cdc.read_replica(spark, replica))) == newest(rows)
    cdc.compact_replica(spark, replica, horizon="0 seconds")
    merged = cdc.read_replica(spark, replica)
    gone = merged.filter("deleted")
    assert state(cdc.live_rows(merged)) == newest(rows) and gone.count() == 0
    assert cdc.replica_report(spark, replica)["levels"] == [0, 0, 1]


def in_order(spark, rows, schema, path, files):
    """Files taken one after the other, whatever their names."""
    for i in range(files):
        spark.createDataFrame(rows[i * len(rows) // files:(i + 1) * len(rows) // files], schema).coalesce(1).write.mode(
            "append").json(path)
        known = getattr(in_order, "known", set())
        for file in set(Path(path).glob("*.json")) - known:
            os.utime(file, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
        in_order.known = known | set(Path(path).glob("*.json"))


def one_by_one(spark, source, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)


def test_replica_reads_few_runs_after_many_batches_and_goes_on_from_them(spark, folder, monkeypatch):
    monkeypatch.setattr(cdc, "FANOUT", 2)
    rows, source, replica, mark = sorted(feed(n=240), key=lambda r: r[1]), folder("in"), folder("replica"), folder("mark")
    for begin, files in ((0, 6), (120, 8)):  # the second start goes on from merged runs
        in_order(spark, rows[begin:begin + 120], CHANGE, source, files)
        cdc.start_replication(one_by_one(spark, source, CHANGE), replica, mark).awaitTermination()
        report = cdc.replica_report(spark, replica)
        assert sum(report["levels"]) <= 5 and report["levels"][2] <= 1
        assert state(cdc.live_rows(cdc.read_replica(spark, replica))) == newest(rows[:begin + 120])
    assert report["version"] == 13
    plan = cdc.read_replica(spark, replica)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    listed = {p.name for p in Path(f"{replica}/data").iterdir()}
    assert len(listed) <= 5 * (manifest.KEPT + 1)  # what no kept version names is gone


@pytest.mark.parametrize("operator", ["replica", "totals"])
def test_a_crash_before_the_swap_changes_nothing_for_readers(spark, folder, monkeypatch, operator):
    rows, source, path, mark = sorted(feed(n=60), key=lambda r: r[1]), folder("in"), folder(operator), folder("mark")
    rows = [(*r[:6], None if r[1] % 2 else 3, r[7] if r[0] == "index" else None) for r in rows]
    in_order(spark, rows[:30], CHANGE, source, 2)

    def run():
        start = cdc.start_replication if operator == "replica" else cdc.start_totals
        start(one_by_one(spark, source, CHANGE), path, mark).awaitTermination()

    def seen():
        found = cdc.read_replica(spark, path) if operator == "replica" else cdc.read_totals(spark, path)
        return sorted(map(str, found.collect()))

    run()
    before = seen()
    in_order(spark, rows[30:], CHANGE, source, 1)
    publish = manifest.Manifest.publish
    monkeypatch.setattr(manifest.Manifest, "publish", lambda self, content: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
        run()
    assert seen() == before
    monkeypatch.setattr(manifest.Manifest, "publish", publish)
    run()
    table = spark.createDataFrame(rows, CHANGE)
    if operator == "replica":
        assert state(cdc.live_rows(cdc.read_replica(spark, path))) == state(cdc.live_rows(cdc.apply_changes(empty_target(spark), table)))
    else:
        assert seen() == sorted(map(str, cdc.running_totals(table).collect()))
        assert cdc.totals_report(spark, path) == {"rows": 60, "counted": 60, "repeated": 0, "late": 0}


def test_a_batch_that_was_published_is_not_applied_again(spark, folder, monkeypatch):
    source, path = folder("in"), folder("totals")
    in_order(spark, feed(n=20), CHANGE, source, 1)
    publish = manifest.Manifest.publish

    def then_fail(self, content):
        publish(self, content)
        raise RuntimeError("lost after the swap")

    mark = folder("mark")
    monkeypatch.setattr(manifest.Manifest, "publish", then_fail)
    with pytest.raises(Exception, match="lost after the swap"):
        cdc.start_totals(one_by_one(spark, source, CHANGE), path, mark).awaitTermination()
    monkeypatch.setattr(manifest.Manifest, "publish", publish)
    cdc.start_totals(one_by_one(spark, source, CHANGE), path, mark).awaitTermination()
    assert cdc.totals_report(spark, path) == {"rows": 20, "counted": 20, "repeated": 0, "late": 0}


def hour(op, version, at, value, old=None):
    return (op, version, T0 + timedelta(hours=at), T0 + timedelta(hours=at), "A" if version < 9 else "B", "W", old, value)


def test_tombstones_and_identities_leave_with_the_horizon(spark, folder, monkeypatch):
    monkeypatch.setattr(cdc, "FANOUT", 1)
    source, replica, totals = folder("in"), folder("replica"), folder("totals")
    rows = [hour("index", 1, 0, 5), hour("delete", 2, 1, None, 5), hour("index", 10, 30, 4), hour("index", 11, 31, 6, 4),
            hour("index", 12, 32, 7, 6), hour("index", 1, 0, 5), hour("index", 12, 32, 7, 6)]
    in_order(spark, rows, CHANGE, source, len(rows))
    cdc.start_replication(one_by_one(spark, source, CHANGE), replica, folder("m1"), horizon="24 hours").awaitTermination()
    found = cdc.read_replica(spark, replica)
    assert state(cdc.live_rows(found)) == {("B", "W"): (12, 7)} and found.filter("deleted").isEmpty()
    assert cdc.replica_report(spark, replica)["late"] == 1  # version 1 again: it can't bring the row back
    cdc.start_totals(one_by_one(spark, source, CHANGE), totals, folder("m2"), horizon="24 hours").awaitTermination()
    assert tuple(cdc.read_totals(spark, totals).first()) == ("W", 1, 7)
    assert cdc.totals_report(spark, totals) == {"rows": 7, "counted": 5, "repeated": 1, "late": 1}
    content = manifest.Manifest(spark, totals).read()
    held = cdc._run(spark, totals, content["runs"], content["schema"])
    assert {r["version"] for r in held.collect()} == {10, 11, 12}


def test_retention_counts_add_up_and_state_stays_small(spark, folder):
    rng = random.Random(8)
    rows = [("index", v, T0 + timedelta(hours=v), T0 + timedelta(hours=v + rng.randrange(30)), f"I{v}", "W", None, v) for v in range(200)]
    rows += rng.sample(rows[150:], 20)  # delivered twice
    rows.sort(key=lambda r: r[3])
    source, path = folder("in"), folder("out")
    in_order(spark, rows, CHANGE, source, 8)
    counts = cdc.RetentionCounts()
    spark.streams.addListener(counts)
    try:
        for running in cdc.start_retention(one_by_one(spark, source, CHANGE), path, folder("mark")):
            running.awaitTermination()
        for _ in range(100):
            if counts.rows == len(rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    late = sum(r[3] - r[2] > timedelta(hours=24) for r in rows)
    in_time, apart = (spark.read.parquet(f"{path}/{side}") for side in ("in_time", "quarantine"))
    assert (counts.rows, counts.late, counts.behind, apart.count()) == (len(rows), late, 0, late)
    once = {r[1] for r in rows if r[3] - r[2] <= timedelta(hours=24)}
    assert in_time.count() == len(once) and {r["version"] for r in in_time.collect()} == once
    assert max(counts.state_rows) <= 2 * (24 + 30 + 30) and counts.state_rows[-1] < len(once) / 2


def test_latest_skips_files_written_before(spark, folder):
    source = folder("in")
    write_files(spark, feed(n=10), CHANGE, source, 1)
    future = read_changes(spark, source, since_ms=4102444800000)
    cdc.start_replication(future, folder("r"), folder("m")).awaitTermination()
    assert read_changes(spark, source, stream=False).count() == 10


def test_late_changes_split_on_tables_and_streams(spark, folder):
    rows = feed(n=60)
    table = spark.createDataFrame(rows, CHANGE)
    in_time, late = cdc.late_changes(table)
    want = sum(r[3] - r[2] > timedelta(hours=24) for r in rows)
    assert (late.count(), in_time.count()) == (want, 60 - want)
    source, out = folder("in"), folder("out")
    write_files(spark, rows, CHANGE, source, 2)
    late_stream = cdc.late_changes(read_changes(spark, source))[1]
    late_stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", folder("m")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == want


REQUEST = "request_id long, ts timestamp, run_id string, variant string, latency_ms long, status string"


def requests(n=600):
    rng = random.Random(5)
    return [
        (i, T0 + timedelta(milliseconds=i * 40), f"r{i % 2}", "bad" if i % 2 else "good", rng.randrange(300),
         rng.choice(["success", "success", "throttled", "error"])) for i in range(n)
    ]


def run_append(spark, stream, out, mark):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@pytest.mark.parametrize("operator", [live.per_second, live.interval_deltas, live.per_minute])
def test_stream_equals_table(spark, folder, operator):
    rows, source = requests(), folder("in")
    # An event far ahead closes every other window.
    rows.append((9999, T0 + timedelta(hours=5), "r0", "good", 1, "success"))
    write_files(spark, rows, REQUEST, source, 3, order=lambda r, i, k: r[i * len(r) // k:(i + 1) * len(r) // k])
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(source)
    got = run_append(spark, operator(stream, watermark="10 minutes"), folder("out"), folder("mark"))
    table = operator(spark.createDataFrame(rows, REQUEST))
    want = {tuple(r) for r in table.collect()}
    open_window = {tuple(r) for r in operator(spark.createDataFrame(rows[-1:], REQUEST)).collect()}
    assert {tuple(r) for r in got.collect()} == want - open_window


SHIP = "request_id long, ts timestamp, item_id string, warehouse_id string, quantity long"


def asked(n=300):
    rng = random.Random(11)
    return [(i, T0 + timedelta(seconds=i), f"I{0 if i % 3 else i % 7}", "W", rng.randint(1, 9)) for i in range(n)]


@pytest.mark.parametrize("how", ["state", "batches", "batches-sliced"])
def test_continuous_decrement_equals_batch(spark, folder, how):
    rows, source = asked(), folder("in")
    # Separate folders of increasing age keep the micro-batches in time order.
    for i in range(3):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], SHIP).coalesce(1).write.mode("append").json(source)
    opening = spark.createDataFrame([(f"I{k}", "W", 60 * (k + 1)) for k in range(6)],
                                    "item_id string, warehouse_id string, quantity long")
    want = {r["request_id"]: (r["accepted"], r["stock_after"])
            for r in ledger.ship_batch(opening, spark.createDataFrame(rows, SHIP)).collect()}
    stream = spark.readStream.schema(SHIP).option("maxFilesPerTrigger", 1).json(source)
    if how == "state":
        got = run_timed(spark, stream, opening, "0 seconds", folder("out"), folder("mark"))
    else:
        path = folder("ship")
        options = {"hot_rows": 30} if how.endswith("sliced") else {}
        ship.start_shipping(stream, opening, path, folder("mark"), **options).awaitTermination()
        got = spark.read.parquet(f"{path}/decisions")
        closing = {r["item_id"]: r["quantity"] for r in ship.current_stock(spark, opening, path).collect()}
        taken = {}
        for i, _, item, _, quantity in rows:
            taken[item] = taken.get(item, 0) + (quantity if want[i][0] else 0)
        assert closing == {f"I{k}": 60 * (k + 1) - taken.get(f"I{k}", 0) for k in range(6)}
    assert {r["request_id"]: (r["accepted"], r["stock_after"]) for r in got.collect()} == want


def run_timed(spark, stream, opening, delay, out, mark):
    with ship.timer_state(spark):
        done = run_append(spark, ship.ship_stream(stream, opening, delay), out, mark)
    return done.unionByName(ship.waiting_decisions(spark, mark))


@pytest.fixture(scope="module")
def delayed(spark, sf, tmp_path_factory):
    """The given tables with ``events`` in 130 files, out of order by up to five hours."""
    folder = tmp_path_factory.mktemp("delayed")
    log = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts")
    shift = pd.to_timedelta(log["event_id"] * 7919 % 18_000, unit="s")
    log = log.assign(file=(log["ts"] + shift).rank(method="first").astype(int) * 130 // (len(log) + 1))
    (folder / "events.parquet").mkdir()
    for file, rows in log.groupby("file"):
        name = folder / "events.parquet" / f"{9_999 - file}.parquet"
        rows.drop(columns="file").to_parquet(name, index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(name, (1_700_000_000 + file, 1_700_000_000 + file))
    (folder / "customer.parquet").symlink_to(f"{sf}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["sta_2_ship_stream", "sta_2_ship_micro_batches"])
def test_decisions_with_a_bounded_delay_equal_their_sql(spark, sf, delayed, name, monkeypatch):
    early = []
    waiting, finish = ship.waiting_decisions, ship.finish_shipping
    monkeypatch.setattr(ship, "waiting_decisions", lambda s, mark: early.append(held(waiting(s, mark))) or waiting(s, mark))
    monkeypatch.setattr(ship, "finish_shipping", lambda s, opening, path: early.append(
        spark.read.parquet(f"{path}/waiting").groupBy("batch_id").count().agg(F.max("count")).first()[0]) or finish(s, opening, path))
    cols, names, _, _, mine, theirs = compare(spark, connect(sf), QUERIES[name], ORACLES[name], delayed)
    assert cols == names and mine == theirs
    total = spark.read.parquet(f"{delayed}/events.parquet").count()
    assert 0 < early[0] < total / 3  # all others were decided while the log was read


def held(waiting):
    return waiting.count()


@pytest.fixture(scope="module")
def scattered(spark, sf, tmp_path_factory):
    """The given tables with ``events`` dealt over 130 files in no order."""
    folder = tmp_path_factory.mktemp("scattered")
    spark.read.parquet(f"{sf}/events.parquet").repartition(130, F.xxhash64("event_id")).write.option(
        "maxRecordsPerFile", 7).parquet(f"{folder}/events.parquet")
    (folder / "customer.parquet").symlink_to(f"{sf}/customer.parquet")
    assert len(list((folder / "events.parquet").glob("*.parquet"))) >= 130
    return str(folder)


@pytest.mark.parametrize("name", ["str_3_stream_per_hour"])
def test_streams_of_many_shuffled_files_equal_their_sql(spark, sf, scattered, name):
    cols, names, _, _, mine, theirs = compare(spark, connect(sf), QUERIES[name], ORACLES[name], scattered)
    assert cols == names and mine == theirs


@pytest.mark.parametrize("how", ["state", "batches"])
def test_late_requests_are_decided_and_marked(spark, folder, how):
    opening = spark.createDataFrame([("A", "W", 10)], "item_id string, warehouse_id string, quantity long")
    rows = [(i, T0 + timedelta(seconds=s), "A", "W", 4) for i, s in enumerate([100, 90, 200, 95, 400, 10])]
    source = folder("in")
    for part in (rows[:2], rows[2:3], rows[3:4], rows[4:5], rows[5:]):
        spark.createDataFrame(part, SHIP).coalesce(1).write.mode("append").json(source)
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(SHIP).option("maxFilesPerTrigger", 1).json(source)
    if how == "state":
        out = folder("out")
        got = run_timed(spark, stream, opening, "50 seconds", out, folder("mark"))
        emitted = {r["request_id"] for r in spark.read.parquet(out).collect()}
        assert emitted == {0, 1, 2, 3, 5}  # 4 waits for an event after 450 s; every other one was decided once
        assert got.count() == 6
    else:
        path = folder("ship")
        ship.start_shipping(stream, opening, path, folder("mark"), delay="50 seconds").awaitTermination()
        assert {r["request_id"] for r in spark.read.parquet(f"{path}/decisions").collect()} == {0, 1, 2, 3, 5}
        ship.finish_shipping(spark, opening, path)
        got = spark.read.parquet(f"{path}/decisions")
        assert ship.current_stock(spark, opening, path).first()["quantity"] == 2
    found = {r["request_id"]: (r["accepted"], r["late"]) for r in got.collect()}
    # 1 at 90 s and 0 at 100 s are final once 2 at 200 s is seen, so 3 at 95 s comes too late.
    assert found == {0: (True, False), 1: (True, False), 2: (False, False), 3: (False, True), 4: (False, False), 5: (False, True)}


def test_shipping_starts_from_a_copy_of_the_stock(spark, folder, monkeypatch):
    monkeypatch.setattr(ship, "COMPACT_EVERY", 2)
    rows, source, path = asked(120), folder("in"), folder("ship")
    for i in range(6):
        spark.createDataFrame(rows[i * 20:(i + 1) * 20], SHIP).coalesce(1).write.mode("append").json(source)
    opening = spark.createDataFrame([(f"I{k}", "W", 60) for k in range(6)], "item_id string, warehouse_id string, quantity long")
    stream = spark.readStream.schema(SHIP).option("maxFilesPerTrigger", 1).json(source)
    ship.start_shipping(stream, opening, path, folder("mark"), delay="1 day").awaitTermination()
    ship.finish_shipping(spark, opening, path)
    want = {r["request_id"]: r["accepted"] for r in ledger.ship_batch(opening, spark.createDataFrame(rows, SHIP)).collect()}
    assert {r["request_id"]: r["accepted"] for r in spark.read.parquet(f"{path}/decisions").collect()} == want
    plan = ship.current_stock(spark, opening, path)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: .*batch_id#\d+ > 6\)", plan)  # nothing before the last copy is read


def test_running_totals_follow_the_replica(spark):
    rows = [("index", 1, T0, T0, "A", "W", None, 5), ("index", 2, T0, T0, "A", "W", 5, 3),
            ("index", 3, T0, T0, "B", "W", None, 4), ("delete", 4, T0, T0, "A", "W", 3, None)]
    changes = spark.createDataFrame(rows, CHANGE)
    assert tuple(cdc.running_totals(changes).first()) == ("W", 1, 4)
    live_now = cdc.live_rows(cdc.apply_changes(empty_target(spark), changes))
    assert live_now.agg(F.count(F.lit(1)), F.sum("new_quantity")).first()[:] == (1, 4)


def test_redelivered_changes_count_once(spark, folder):
    rows = [("index", 1, T0, T0, "A", "W", None, 5), ("index", 2, T0, T0, "A", "W", 5, 3), ("index", 1, T0, T0, "A", "W", None, 5)]
    assert tuple(cdc.running_totals(spark.createDataFrame(rows, CHANGE)).first()) == ("W", 1, 3)
    source, path = folder("in"), folder("totals")
    write_files(spark, rows, CHANGE, source, 3)
    for mark in ("m1", "m2"):
        stream = read_changes(spark, source, max_files_per_trigger=1)
        cdc.start_totals(stream, path, folder(mark)).awaitTermination()
        assert tuple(cdc.read_totals(spark, path).first()) == ("W", 1, 3)


def test_an_item_takes_few_round_trips_a_batch():
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.value = name, None

        def __getattr__(self, call):
            return lambda *a: calls.append((self.name, call)) or (
                self.value if call == "get" and self.value else iter(()) if self.name == "waiting" and call == "get"
                else [] if call == "listTimers" else False if call == "exists" else None)

    class Handle(State):
        def getValueState(self, name, _):
            return State(name)

        getListState = getValueState

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    item = ship._Shipping(0, 10)
    item.init(Handle("handle"))
    rows = pd.DataFrame({"at": [10_000, 20_000], "request_id": [1, 2], "quantity": [3, 4], "stock_quantity": [5, 5]})
    assert list(item.handleInputRows(("A", "W"), iter([rows]), Clock())) == []
    assert [c for c in calls if c[1] in ("update", "put", "registerTimer")] == [
        ("waiting", "put"), ("handle", "registerTimer"), ("left", "update")]
    assert len(calls) == 4  # and one look at the state
