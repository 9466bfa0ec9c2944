import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depotlens.operators import skew
from depotlens.operators.paging import ordered_page
from depotlens.operators.search import Criteria, capped_search, capped_search_views, get_item, search
from depotlens.schemas import WAREHOUSES
from depotlens.sources import catalogue, tables
from depotlens.sources.views import open_views


def hot(spark, n=3000):
    """One group holds a third of all rows, values tie heavily."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 13).alias("x"), "id",
    )


@pytest.mark.parametrize("within", [[], ["g"]])
def test_rank_equals_row_number(spark, within):
    df = hot(spark)
    window = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))).orderBy("x", "id")
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(window)).collect()}
    ranked = skew.global_rank(df, ["x", "id"], within, partitions=9)
    assert {r["id"]: r["rank"] for r in ranked.collect()} == want


def test_hot_group_is_cut_into_chunks(spark):
    placed = skew.ordered_positions(hot(spark), ["g", "x", "id"], 8)
    chunks = placed.filter("g = 'hot'").groupBy("chunk").count().collect()
    assert len(chunks) >= 3 and max(r["count"] for r in chunks) < 900


def test_running_sum_equals_window(spark):
    placed = skew.ordered_positions(hot(spark), ["g", "x", "id"], 6)
    got = skew.chunked_running_sum(placed, ["g"], F.col("x"), "before").select("id", "before")
    window = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = hot(spark).select("id", F.coalesce(F.sum("x").over(window), F.lit(0)).alias("before"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("how,salt", [("hash", "id"), ("value", "id"), ("first_char", "g")])
def test_salting_changes_nothing(spark, how, salt):
    df = hot(spark)
    got = skew.salted_totals(df, "g", salt, "x", 10, how).select("g", "n", "total")
    want = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_keys_and_levels(spark):
    df = spark.createDataFrame([("A-03-02", 1640, 5), ("A-03-02", 99, 2), ("B-01-01", 7, 1)], "loc string, price long, q long")
    keyed = df.withColumn("k", skew.composite_key(F.col("loc"), (F.col("price"), 6)))
    assert [r["k"] for r in keyed.orderBy("k").collect()] == ["A-03-02#000099", "A-03-02#001640", "B-01-01#000007"]
    levels = {(r["level"], r["prefix"]): (r["n"], r["total"]) for r in skew.prefix_levels(keyed, "k", "q").collect()}
    assert levels[(1, "A-03-02")] == (2, 7) and levels[(2, "B-01-01#000007")] == (1, 1) and len(levels) == 5
    assert spark.range(1).select(skew.sharded_key(F.lit("DAILY"), F.lit(3))).first()[0] == "DAILY#3"
    with pytest.raises(ValueError):
        skew.shard_of(F.lit("a"), 3, "other")


def test_three_keys_leave_most_segments_empty(spark, stock):
    report = skew.segment_skew(stock, "warehouse_id", 27).collect()
    assert len(report) == 27 and sum(r["n_rows"] for r in report) == stock.count()
    assert sum(r["n_rows"] > 0 for r in report) <= 3


def _rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_reads_skip_row_groups_without_the_id(spark, stock, tmp_path):
    folders = catalogue.write_layouts(stock, str(tmp_path / "layouts"), files=6)
    order = ["warehouse_id", "unit_price", "item_id"]
    stock.repartitionByRange(6, *order).sortWithinPartitions(*order).write.partitionBy("warehouse_id").parquet(
        str(tmp_path / "plain"))
    ids = sorted(r["item_id"] for r in stock.filter("warehouse_id = 'WH-TOKYO'").select("item_id").collect())
    some = ids[len(ids) // 4:3 * len(ids) // 4]
    picked = some[::max(len(some) // 12, 1)][:12]
    absent = [i + "0" for i in picked]  # right behind an id that exists, so inside the range of every row group
    assert not set(absent) & set(ids)
    plain = spark.read.parquet(str(tmp_path / "plain"))
    assert all(_rows_scanned(get_item(plain, "WH-TOKYO", i)) > 0 for i in absent[:3])
    for name in ("by_unit_price", "by_item"):
        table = spark.read.parquet(folders[name])
        assert sum(_rows_scanned(get_item(table, "WH-TOKYO", i)) == 0 for i in absent) >= 10  # the filter errs at 1 %
        assert all(get_item(table, "WH-TOKYO", i).count() == 1 for i in picked[:4])


def test_layouts_prune_partitions_and_push_filters(spark, stock, tmp_path, capsys):
    folders = catalogue.write_layouts(stock, str(tmp_path), files=6)
    assert set(folders) == {"by_warehouse", "by_location", "by_unit_price", "by_item"}
    table = spark.read.parquet(folders["by_unit_price"])
    found = search(table, Criteria("WH-TOKYO", item_prefix="ITEM#ETH-", min_price=905, max_price=910))
    found.select("item_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(warehouse_id" in plan
    for pushed in ("StringStartsWith(item_id,ITEM#ETH-)", "GreaterThanOrEqual(unit_price,905)", "LessThanOrEqual(unit_price,910)"):
        assert pushed in plan
    assert "item_name" not in plan.split("ReadSchema")[1] and "BatchEvalPython" not in plan
    assert found.count() == search(stock, Criteria("WH-TOKYO", "ITEM#ETH-", min_price=905, max_price=910)).count()
    import os
    files = [f for f in os.listdir(f"{folders['by_unit_price']}/warehouse_id=WH-TOKYO") if f.endswith(".parquet")]
    assert len(files) >= 2  # a warehouse is not one file


@pytest.fixture(scope="module")
def views(spark, stock, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("views"))
    catalogue.write_layouts(stock, path, files=24)
    return open_views(spark, path)


@pytest.mark.parametrize("axis", ["item_id", "location", "unit_price"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_view_pages_equal_top_k_pages(stock, views, axis, order):
    plain, token, guard = stock.filter("warehouse_id = 'WH-OSAKA'"), None, 0
    while True:
        rows = views[axis].slice("WH-OSAKA", order=order, token=token, size=15)
        want = ordered_page(plain, axis, order, token, 15)
        got = ordered_page(rows.filter("warehouse_id = 'WH-OSAKA'"), axis, order, token, 15)
        assert [r.asDict() for r in got.rows.select(plain.columns).collect()] == [r.asDict() for r in want.rows.collect()]
        assert got.next_token() == want.next_token()
        assert len(rows.inputFiles()) <= 5
        token, guard = want.next_token(), guard + 1
        if token is None:
            break
    assert guard == 14


@pytest.mark.parametrize("criteria", [
    Criteria("WH-TOKYO", location_prefix="C-", min_quantity=200), Criteria("WH-TOKYO", min_price=910, item_name="red"),
    Criteria("WH-TOKYO", max_price=903), Criteria("WH-TOKYO", item_prefix="ITEM#KEN-", max_quantity=700),
    Criteria("WH-TOKYO", item_prefix="ITEM#ZZ"), Criteria("WH-NONE"), Criteria(item_name="red"), Criteria("WH-TOKYO"),
])
def test_capped_search_on_views(stock, views, criteria):
    def ids(df):
        return [r["item_id"] for r in df.orderBy("unit_price", "location", "item_id").collect()]

    token = None
    for _ in range(3):
        want, got = capped_search(stock, criteria, token), capped_search_views(views, criteria, token)
        assert ids(got.rows) == ids(want.rows) and got.filters == want.filters and got.note == want.note
        token = want.page.next_token() if want.page else None
        if got.page:
            assert got.page.next_token() == token
        if token is None:
            break


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_view_slices_with_a_prefix(stock, views, order):
    for axis, prefix in (("location", "D-"), ("item_id", "ITEM#BRA-")):
        rows = views[axis].slice("WH-TOKYO", prefix=prefix, order=order)
        keep = f"warehouse_id = 'WH-TOKYO' AND startswith({axis}, '{prefix}')"
        got = [r["item_id"] for r in ordered_page(rows.filter(keep), axis, order).rows.collect()]
        assert got == [r["item_id"] for r in ordered_page(stock.filter(keep), axis, order).rows.collect()]


def test_view_in_a_folder_with_odd_names(spark, stock, tmp_path):
    from depotlens.sources.views import OrderedView, write_ordered_view

    odd = stock.filter("warehouse_id = 'WH-OSAKA'").withColumn("warehouse_id", F.lit("WH #1 50%"))
    write_ordered_view(odd, str(tmp_path / "a b"), "location", 4)
    rows = OrderedView(spark, str(tmp_path / "a b"), "location").slice("WH #1 50%")
    assert ordered_page(rows, "location").rows.count() == 20


def test_expansion_has_no_join(spark, sf):
    skus = tables.skus(spark, sf)
    expanded = catalogue.expand_catalogue(skus, WAREHOUSES)
    assert expanded.count() == 3 * skus.count() and "_position" not in expanded.columns
    assert "Join" not in expanded._jdf.queryExecution().optimizedPlan().toString()


def test_put_all_twice_changes_nothing(spark, stock):
    target = stock.select("item_id", "warehouse_id", "quantity")
    batch = target.limit(50).withColumn("quantity", F.lit(1).cast("bigint"))
    once = catalogue.put_all(target, batch)
    twice = catalogue.put_all(once, batch)
    assert once.count() == target.count()
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}


def test_cap_comes_before_distinct(spark):
    df = spark.createDataFrame([("W", "a"), ("V", "a"), ("", "b"), ("W", "c")], "warehouse_id string, item_id string")
    assert catalogue.distinct_pairs_of_head(df, 3).count() == 2
    assert [r[0] for r in catalogue.distinct_keys(df, 2).collect()] == ["a", "b"]
    assert catalogue.probe_keys(df, "W", "good", 3).count() == 2
    assert catalogue.probe_keys(df, "W", "badOnDemand", 3).count() == 2


def test_snapshot_schema_is_given(spark, stock, tmp_path):
    stock.write.json(str(tmp_path / "s"))
    back = catalogue.read_snapshot(spark, str(tmp_path / "s"))
    assert back.schema["quantity"].dataType.simpleString() == "bigint" and back.count() == stock.count()


def test_typed_export(spark, tmp_path):
    (tmp_path / "part-0.json").write_text(
        '{"Item":{"warehouseId":{"S":"WH-TOKYO"},"itemId":{"S":"ITEM#A"},"itemName":{"S":"a"},"quantity":{"N":"12"},'
        '"lotNumber":{"S":"L"},"location":{"S":"A-01-01"},"unitPrice":{"N":"980"},'
        '"lastUpdated":{"S":"2026-05-20T10:00:00.000Z"}}}\n{"Item":{"itemId":{"S":"ITEM#B"}}}\n')
    rows = {r["item_id"]: r for r in catalogue.read_typed_export(spark, str(tmp_path)).collect()}
    assert (rows["ITEM#A"]["quantity"], rows["ITEM#A"]["unit_price"], rows["ITEM#A"]["location"]) == (12, 980, "A-01-01")
    assert rows["ITEM#A"]["last_updated"] is not None and rows["ITEM#B"]["quantity"] is None


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from depotlens.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)


def test_search_plans_stay_in_the_jvm(spark, sf):
    from depotlens.plans import QUERIES

    for name in ("flt_9_all_criteria", "pag_1_ordered_page", "agg_8_rounds_and_run", "pag_6_relevance_items"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_put_all_with_missing_and_negative_sequence(spark):
    from depotlens.sources.catalogue import put_all

    target = spark.createDataFrame([("A", "W", 1), ("B", "W", 1), ("C", "W", 1)], "item_id string, warehouse_id string, quantity long")
    batch = spark.createDataFrame(
        [("A", "W", 2, None), ("B", "W", 3, -7), ("B", "W", 2, None), ("D", "W", 5, None), ("C", "W", 8, -9), ("C", "W", 9, -2)],
        "item_id string, warehouse_id string, quantity long, seq long")
    found = {r["item_id"]: r["quantity"] for r in put_all(target, batch, seq="seq").collect()}
    assert found == {"A": 2, "B": 3, "C": 9, "D": 5}
    tied = batch.withColumn("seq", F.lit(1))
    once = sorted(map(tuple, put_all(target, tied, seq="seq").collect()))
    assert once == sorted(map(tuple, put_all(target, tied.orderBy("quantity"), seq="seq").collect()))
