import os
import time
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from test_streams import T0, feed, folder  # noqa: F401

from depotlens.schemas import CHANGE
from depotlens.sources.feed import Ledger, feed_length, read_feed, replay_feed


def push(spark, path, rows, files=1, fmt="json"):
    spark.createDataFrame(rows, CHANGE).repartition(files).write.mode("append").format(fmt).save(path)


def run(stream, out, checkpoint, fail=False):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if fail:
            raise RuntimeError("stopped on purpose")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def versions(spark, out):
    return sorted(r["version"] for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_latest_goes_on_without_gap_or_repeat(spark, folder, fmt):  # noqa: F811
    path, out, mark = folder("in"), folder("out"), folder("mark")
    ledger, rows = f"{mark}/ledger", sorted(feed(n=60), key=lambda r: r[1])
    stream = lambda: read_feed(spark, path, ledger, files=fmt)
    push(spark, path, rows[:20], 3, fmt)
    run(stream(), out, mark)
    old = [os.path.join(path, f) for f in os.listdir(path)]
    for at in range(20, 60, 10):
        for name in old:  # touched later, but found before the start
            os.utime(name, (time.time() + 3600, time.time() + 3600))
        push(spark, path, rows[at:at + 10], 2, fmt)
        run(stream(), out, mark)
        run(stream(), out, mark)
        assert versions(spark, out) == list(range(20, at + 10))
    got = {tuple(r)[:8] for r in spark.read.schema(CHANGE).parquet(out).collect()}
    assert got == {tuple(r) for r in rows[20:]}


def test_first_batch_is_repeated_from_where_it_began(spark, folder):  # noqa: F811
    path, out, mark = folder("in"), folder("out"), folder("mark")
    ledger, rows = f"{mark}/ledger", sorted(feed(n=30), key=lambda r: r[1])
    push(spark, path, rows[:10])
    with pytest.raises(StreamingQueryException):
        run(read_feed(spark, path, ledger, "earliest"), out, mark, fail=True)
    push(spark, path, rows[10:20])
    run(read_feed(spark, path, ledger, "latest"), out, mark)  # the ledger knows where it began
    run(read_feed(spark, path, ledger), out, mark)
    assert versions(spark, out) == list(range(20))


def test_ranges_can_be_read_again(spark, folder):  # noqa: F811
    path, out, mark = folder("in"), folder("out"), folder("mark")
    ledger, rows = f"{mark}/ledger", sorted(feed(n=40), key=lambda r: r[1])
    for at in range(0, 40, 10):
        push(spark, path, rows[at:at + 10])
        run(read_feed(spark, path, ledger, "earliest"), out, mark)
    length = feed_length(path, ledger)
    parts = [replay_feed(spark, path, ledger, k, k + 1).collect() for k in range(length)]
    assert sorted(r["version"] for p in parts for r in p) == list(range(40))
    assert [r["version"] // 10 for p in parts for r in p] == sorted(r[1] // 10 for r in rows)
    assert replay_feed(spark, path, ledger, 0, length).count() == 40
    other, later = folder("other"), folder("later")
    run(read_feed(spark, path, f"{other}/ledger", 2), later, other)
    assert set(versions(spark, later)) < set(range(40)) and max(versions(spark, later)) == 39
    with pytest.raises(Exception, match="no files"):
        replay_feed(spark, path, ledger, 0, length + 1).count()


def test_a_running_query_sees_new_files_and_skips_old_ones(spark, folder):  # noqa: F811
    path, out, mark = folder("in"), folder("out"), folder("mark")
    rows = sorted(feed(n=30), key=lambda r: r[1])
    push(spark, path, rows[:10])
    running = read_feed(spark, path, f"{mark}/ledger").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", mark).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(300):
            if os.path.exists(f"{mark}/ledger/start.json"):
                break
            time.sleep(0.1)
        push(spark, path, rows[10:20])
        push(spark, path, rows[20:])
        for _ in range(300):
            running.processAllAvailable()
            if feed_length(path, f"{mark}/ledger") == len([f for f in os.listdir(path) if f.startswith("part-")]):
                break
            time.sleep(0.1)
        running.processAllAvailable()
    finally:
        running.stop()
    assert versions(spark, out) == list(range(10, 30))


def named(path, name, text="{}\n"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_ledger_merges_its_entries_and_survives_a_crash_between(folder):  # noqa: F811
    path, at = folder("in"), folder("ledger")
    ledger = Ledger(at, path, merge=8)
    for k in range(30):
        named(path, f"{'zyx'[k % 3]}{k}.json")
        named(path, f"_{k}.json")
        assert ledger.refresh() == k + 1
        ledger.merge()
        assert len(os.listdir(f"{at}/entries")) < 8 + 1
    order = [name for name, _ in ledger.files(0, 30)]
    assert [int(n.rsplit("/", 1)[1][1:-5]) for n in order] == list(range(30))
    # The merged entry is in place, the old ones are still there.
    for first in range(30):
        with open(f"{at}/entries/{first:015d}-{first + 1:015d}.json", "w") as f:
            f.write(f'[["stale{first}", 1]]')
    with open(f"{at}/entries/{0:015d}-{30:015d}.json", "w") as f:
        import json

        json.dump([[n.rsplit("/", 1)[1], 3] for n in order], f)
    again = Ledger(at, path, merge=8)
    assert again.refresh() == 30 and [n for n, _ in again.files(3, 9)] == order[3:9]
    again.merge()
    assert os.listdir(f"{at}/entries") == [f"{0:015d}-{30:015d}.json"]
    assert [n for n, _ in Ledger(at, path).files(0, 30)] == order


def test_changed_files_and_odd_starts_are_errors(spark, folder):  # noqa: F811
    path, at = folder("in"), folder("ledger")
    push(spark, path, feed(n=5))
    ledger = Ledger(at, path)
    assert ledger.start("latest") == 1 and Ledger(at, path).start("earliest") == 1
    with pytest.raises(ValueError):
        Ledger(folder("ledger"), path).start("7")
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(os.path.join(path, name), "a") as f:
        f.write("{}\n")
    with pytest.raises(Exception, match="do not change"):
        replay_feed(spark, path, at, 0, 1).count()


def test_empty_feed_and_missing_columns(spark, folder):  # noqa: F811
    path, out, mark = folder("in"), folder("out"), folder("mark")
    run(read_feed(spark, path, f"{mark}/ledger", "earliest"), out, mark)
    named(path, "a.json", '{"op": "index", "version": 1, "item_id": "I", "warehouse_id": "W", "more": [1]}\n')
    named(path, "b.json", "")
    named(path, "c.json", "".join(
        f'{{"op": "index", "version": {v}, "event_ts": "{t}", "item_id": "I", "warehouse_id": "W"}}\n'
        for v, t in ((2, "2026-01-01T00:00:00.5"), (3, "2026-01-01T00:00:00Z"), (4, "2026-01-01T09:00:00.000+09:00"))))
    run(read_feed(spark, path, f"{mark}/ledger", "earliest"), out, mark)
    found = sorted(spark.read.schema(CHANGE).parquet(out).collect(), key=lambda r: r["version"])
    assert [(r["op"], r["version"], r["event_ts"], r["new_quantity"]) for r in found] == [
        ("index", 1, None, None), ("index", 2, T0 + timedelta(milliseconds=500), None), ("index", 3, T0, None),
        ("index", 4, T0, None)]
