import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from depotlens.functions import sketches
from depotlens.functions.percentiles import ranked_percentiles
from depotlens.operators import metrics
from depotlens.operators.search import Criteria, search
from depotlens.sources import curve
from depotlens.sources.views import write_ordered_view
from depotlens.streaming import hot, live

PS = [1, 50, 95, 99, 100]


def values(spark, n=60_000):
    """One group holds a third, another is one value, some keys are null, one group has no value."""
    drawn = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "flat").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(2.5)).otherwise(F.rand(5) * 1000).alias("x"))
    return drawn.unionByName(spark.createDataFrame([("none", None), ("one", 5.5), ("nan", float("nan")), ("nan", 1.0)],
                                                   "g string, x double"))


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("rule", ["floor", "nearest"])
def test_narrowed_percentiles_are_the_ranked_ones(spark, rule):
    df = values(spark)
    full = ranked_percentiles(df.withColumn("g", F.coalesce("g", F.lit("~"))), "x", ["g"], PS, rule)
    assert shown(sketches.narrowed_percentiles(df, "x", ["g"], PS, rule)) == shown(
        full.withColumn("g", F.nullif("g", F.lit("~"))))


def test_wrong_bounds_cost_time_but_not_the_result(spark):
    """Sketches of other values: no rank lies between their bounds."""
    df = values(spark, 6000)
    foreign = df.withColumn("x", F.when(F.col("x").isNotNull(), F.col("x") + 5000)).groupBy("g").agg(
        *sketches.value_sketch("x"))
    assert shown(sketches.narrowed_percentiles(df, "x", ["g"], PS, sketches=foreign)) == shown(
        sketches.narrowed_percentiles(df, "x", ["g"], PS))


def test_percentiles_of_one_group_and_of_none(spark):
    df = spark.range(1, 1001).select((F.col("id") / 10).alias("x"), F.lit("a").alias("p"))
    assert sketches.narrowed_percentiles(df, "x", [], [95]).collect() == [(95.1,)]
    assert sketches.narrowed_percentiles(df.limit(0), "x", ["p"], [95]).collect() == []


def test_key_check_without_counting_clean_segments(spark):
    df = spark.range(40_000).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    dirty = df.unionByName(df.filter("a < 5")).unionByName(df.filter("a = 2"))
    for frame in (df, dirty, df.limit(0)):
        want = frame.withColumn("b", F.coalesce("b", F.lit("-")))
        for segments in (64, 1):  # one segment holds more keys than its sketch
            got = sketches.sketched_key_check(frame, ["a", "b"], segments).first().asDict()
            assert got == metrics.key_check(want, ["a", "b"]).first().asDict()


def test_estimates_keep_their_error_and_loads_merge(spark):
    first = sketches.segment_sketches(spark.range(200_000), ["id"], 2)
    second = sketches.segment_sketches(spark.range(100_000, 300_000), ["id"], 2)
    merged = sketches.distinct_estimates(sketches.merge_loads(first.unionByName(second)))
    assert sum(r["n_keys"] for r in merged.collect()) == pytest.approx(300_000, rel=0.03)
    assert not any(r["exact"] for r in merged.collect())
    both = sketches.common_keys(first, second).agg(F.sum("n_common")).first()[0]
    assert both == pytest.approx(100_000, rel=0.05)
    small = sketches.segment_sketches(spark.range(3000), ["id"], 8)
    assert sketches.distinct_estimates(small).agg(F.sum("n_keys"), F.min("exact")).first() == (3000, True)


def stream_of(spark, tmp_path, batches, schema):
    """Every list of rows is one file, and every file one micro-batch."""
    path = str(tmp_path / f"in-{uuid.uuid4().hex[:6]}")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_hot_keys_that_lead_no_batch(spark, tmp_path, monkeypatch):
    """Keys that are busy over all batches but among the first of none, beside thousands seen once."""
    monkeypatch.setattr(hot, "LEADS", 3)
    rng, batches = random.Random(4), []
    for b in range(6):
        rows = [(f"burst-{b}-{i}",) for i in range(3) for _ in range(9)]
        rows += [(f"steady-{i}",) for i in range(4) for _ in range(7 - i)] + [(None,)] * 2
        rows += [(f"once-{b}-{i}",) for i in range(600)]
        rng.shuffle(rows)
        batches.append(rows)
    stream = stream_of(spark, tmp_path, batches, "item_id string")
    path = str(tmp_path / "hot")
    hot.start_key_counts(stream, "item_id", path, str(tmp_path / "mark")).awaitTermination()
    table = spark.createDataFrame([r for rows in batches for r in rows], "item_id string")
    for n in (3, 5, 12):
        assert hot.read_hot_keys(spark, path, "item_id", n).collect() == metrics.hot_keys(table, "item_id", n).collect()
    assert hot.candidates(spark, path, 3).select("key").distinct().count() < 40
    # A repeated batch overwrites its own folders; estimates are bounds from above.
    counted = table.groupBy(F.col("item_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    checked = hot.estimated_counts(spark, path, counted).collect()
    assert all(r["n"] <= r["estimate"] for r in checked)
    assert sum(r["estimate"] - r["n"] > r["may_exceed_by"] for r in checked) <= 0.007 * len(checked) + 1


def test_window_percentiles_of_a_stream(spark, tmp_path):
    rng, t0 = random.Random(9), datetime(2026, 1, 1)
    rows = [(t0 + timedelta(minutes=rng.randrange(180)), rng.random() * 100) for _ in range(4000)]
    stream = stream_of(spark, tmp_path, [rows[i::4] for i in range(4)], "ts timestamp, ms double")
    path = str(tmp_path / "ms")
    live.start_sketches(stream, "ms", path, str(tmp_path / "mark2"), "1 hour").awaitTermination()
    got = {r["window_start"]: (r["p50"], r["p99"]) for r in live.read_window_percentiles(spark, path, [50, 99]).collect()}
    for hour in range(3):
        held = sorted(v for t, v in rows if t.hour == hour)
        assert got[f"2026-01-01 0{hour}:00:00"] == tuple(held[len(held) * p // 100] for p in (50, 99))


CORNER = Criteria(min_price=200, max_price=320, min_quantity=600, max_quantity=780)


def spread(spark, n=20_000):
    return spark.range(n).select(
        F.format_string("ITEM#%05d", "id").alias("item_id"), F.lit("WH-TOKYO").alias("warehouse_id"),
        F.concat(F.lit("A-"), F.format_string("%03d", (F.col("id") * 577 % 211))).alias("location"),
        F.lit("red ring").alias("item_name"), (F.col("id") * 7919 % 1009).alias("unit_price"),
        F.when(F.col("id") % 100 > 0, F.col("id") * 104729 % 997).alias("quantity"))


@pytest.mark.parametrize("files,axes,most", [(64, curve.CURVE_AXES, 0.30), (512, curve.CURVE_AXES, 0.10),
                                             (512, ("unit_price", "quantity"), 0.05)])
def test_two_ranges_read_a_fraction_of_the_files(spark, files, axes, most):
    """A range of 12 % and one of 18 %: a view ordered by the first of them reads 0.13 of its files, whatever their
    number; one ordered by a third column all of 64 files, and of 512 small ones nearly half."""
    df, file = spread(spark), F.spark_partition_id()
    share = lambda rows: file_boxes_met(rows, axes, file)
    read = share(curve.along_curve(df, files, axes))
    assert read < most
    assert share(df.repartitionByRange(files, "unit_price", "item_id")) > 0.11
    assert share(df.repartitionByRange(files, "location", "item_id")) > 2 * read


def file_boxes_met(rows, axes, file):
    boxes = curve.file_boxes(rows, axes, file)
    met = boxes.agg(F.count_if(curve.meeting(CORNER, axes)), F.count(F.lit(1))).first()
    return met[0] / met[1]


@pytest.mark.parametrize("wanted", [
    Criteria(), Criteria("WH-TOKYO", location_prefix="A-01", max_quantity=40), Criteria("WH-NONE"),
    Criteria(min_price=float("inf")), Criteria(min_price=3.5, max_price=9.5, item_prefix="ITEM#0"),
    Criteria(max_price=-1), Criteria(min_quantity=float("-inf")),
])
def test_curve_search_finds_what_a_scan_finds(spark, tmp_path, wanted):
    df = spread(spark, 2000)
    curve.write_curve_view(df, str(tmp_path / "c"), 8)
    view = curve.CurveView(spark, str(tmp_path / "c"))
    assert view.rows().count() == 2000
    assert sorted(r["item_id"] for r in view.search(wanted).collect()) == sorted(
        r["item_id"] for r in search(df, wanted).collect())


def test_a_hot_place_is_dealt_over_files(spark, tmp_path):
    """A third of the rows share one place; some have no warehouse or no quantity."""
    df = spread(spark, 3000).withColumns({
        **{c: F.when(F.col("item_id") < "ITEM#01000", F.lit(v)).otherwise(F.col(c))
           for c, v in (("unit_price", 7), ("quantity", 7), ("location", "A-7"))},
        "warehouse_id": F.when(F.col("item_id") < "ITEM#02900", F.col("warehouse_id"))})
    sizes = curve.along_curve(df, 20).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 2 * 1.5 * 3000 / 20 and sizes[1] == 3000
    curve.write_curve_view(df, str(tmp_path / "c"), 20)
    assert curve.CurveView(spark, str(tmp_path / "c")).search(Criteria(max_price=7, min_price=7)).count() >= 1000
    curve.write_curve_view(df.limit(0), str(tmp_path / "empty"), 4)
    assert curve.CurveView(spark, str(tmp_path / "empty")).search(Criteria(min_price=1)).count() == 0


def test_curve_place_interleaves(spark):
    row = spark.range(1).select(curve.curve_place([F.lit(0b11), F.lit(0b00), F.lit(0b01)]).alias("z")).first()
    assert row["z"] == 0b100101
