import pytest
from pyspark.sql import functions as F

from depotlens.functions.scalar import decode_token, query_tokens
from depotlens.operators.paging import capped_walk, offset_page, ordered_page, page_info, walk_summary
from depotlens.operators.search import (
    Criteria, capped_search, choose_axis, compare_modes, coverage, get_item, list_inventory, list_inventory_views,
    match_any, mode_summary, search, search_any,
)


def ids(df):
    return [(r["item_id"], r["warehouse_id"]) for r in df.select("item_id", "warehouse_id").collect()]


def test_parse_drops_blank_and_non_numeric():
    got = Criteria.parse({
        "warehouse_id": "  ", "item_prefix": " ITEM#ETH- ", "min_price": "1e3", "max_price": "12abc",
        "min_quantity": "NaN", "max_quantity": "", "unknown": "x",
    })
    assert got == Criteria(item_prefix="ITEM#ETH-", min_price=1000.0)


@pytest.mark.parametrize("text,value", [
    ("1_000", None), ("inf", None), ("Infinity", float("inf")), (" 7 ", 7.0), (".5", 0.5), ("-3", -3.0),
])
def test_parse_numbers(text, value):
    assert Criteria.parse({"min_price": text}).min_price == value


def test_crossed_bounds_find_nothing(stock):
    assert search(stock, Criteria(min_price=910, max_price=905)).count() == 0


def test_prefix_is_case_sensitive_and_anchored(stock):
    assert search(stock, Criteria(item_prefix="item#eth-")).count() == 0
    assert search(stock, Criteria(item_prefix="ETH-")).count() == 0


def test_token_match_is_any_token_and_ignores_case(spark):
    df = spark.createDataFrame([("ベリー 深煎り",), ("シティ 浅煎り",), ("red-bolt",), ("redbolt",)], "item_name string")
    found = lambda q: {r[0] for r in df.filter(match_any("item_name", q)).collect()}
    assert found("ベリー シティ") == {"ベリー 深煎り", "シティ 浅煎り"}
    assert found("RED") == {"red-bolt"}
    assert found("!!") == set()
    assert query_tokens("Red, red_Bolt") == ["red", "bolt"]


def test_axis_priority():
    full = Criteria("W", "I", "L", "N", 1, 2, 3, 4)
    assert (choose_axis(full).view, list(choose_axis(full).residual)) == (
        "byUnitPrice", ["item_id", "location", "item_name", "quantity"])
    no_price = Criteria("W", "I", "L", "N")
    assert (choose_axis(no_price).view, list(choose_axis(no_price).residual)) == (
        "byLocation", ["item_id", "item_name"])
    assert choose_axis(Criteria("W", "I", item_name="N")).view == "byWarehouse"
    assert list(choose_axis(Criteria("W", max_quantity=4)).residual) == ["quantity"]


def test_filters_are_described(stock):
    found = capped_search(stock, Criteria("W", "I#", "A-", "red", 1, None, None, 7.5))
    assert found.filters == (
        'begins_with(item_id, "I#")', 'begins_with(location, "A-")', 'contains(item_name, "red")', "quantity <= 7.5")


def test_capped_page_filters_after_the_read(stock):
    criteria = Criteria("WH-TOKYO", min_quantity=500)
    rows = sorted(
        r.asDict()["item_id"] for r in stock.filter("warehouse_id = 'WH-TOKYO'").collect()
    )[:20]
    first = {r["item_id"]: r["quantity"] for r in stock.filter("warehouse_id = 'WH-TOKYO'").collect()}
    found = capped_search(stock, criteria)
    assert sorted(i for i, _ in ids(found.rows)) == [i for i in rows if first[i] >= 500]
    assert found.view == "byWarehouse" and found.filters == ("quantity >= 500",)
    plan = found.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("GlobalLimit")


def test_capped_cursor_continues_after_last_read_row(stock):
    criteria = Criteria("WH-TOKYO", item_name="red", min_price=905)
    pages, token, guard = [], None, 0
    while True:
        found = capped_search(stock, criteria, token=token)
        pages.append(len(ids(found.rows)))
        token = found.page.next_token()
        guard += 1
        if token is None or guard > 50:
            break
    walk = {r["page"]: r["hits"] for r in capped_walk(stock, criteria).collect()}
    assert pages == [walk[p] for p in sorted(walk)]
    want = stock.filter("warehouse_id = 'WH-TOKYO' AND unit_price >= 905 AND item_name LIKE '%red%'").count()
    assert sum(pages) == want == walk_summary(capped_walk(stock, criteria)).first()["hits"]


def test_capped_without_warehouse_is_empty_with_a_note(stock):
    found = capped_search(stock, Criteria(item_name="red"))
    assert found.rows.count() == 0 and found.view == "none" and found.note


@pytest.mark.parametrize("axis", ["item_id", "location", "unit_price"])
@pytest.mark.parametrize("order", ["asc", "desc", "sideways"])
def test_cursor_pages_make_the_whole_listing(stock, axis, order):
    rows = stock.filter("warehouse_id = 'WH-OSAKA'")
    token, seen = None, []
    for _ in range(20):
        page = ordered_page(rows, axis, order=order, token=token, size=37)
        seen += [(r[axis], r["item_id"]) for r in page.rows.collect()]
        token = page.next_token()
        if token is None:
            break
    want = sorted(((r[axis], r["item_id"]) for r in rows.collect()), reverse=order == "desc")
    assert seen == want


def test_no_cursor_after_an_exactly_full_last_page(stock):
    rows = stock.filter("warehouse_id = 'WH-OSAKA'").orderBy("item_id").limit(40)
    first = ordered_page(rows, "item_id")
    second = ordered_page(rows, "item_id", token=first.next_token())
    assert second.rows.count() == 20 and second.next_token() is None


@pytest.mark.parametrize("token", ["%%%", "bm90IGpzb24", "eyJhIjoxfQ", "W10", "é"])
def test_damaged_cursor(stock, token):
    with pytest.raises(ValueError, match="INVALID_TOKEN"):
        ordered_page(stock, "item_id", token=token)


def test_cursor_text_is_url_safe(stock):
    token = ordered_page(stock, "unit_price").next_token()
    assert set(token) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    assert set(decode_token(token, ["unit_price", "item_id", "warehouse_id"])) == {
        "unit_price", "item_id", "warehouse_id"}


def test_listing_rules(stock):
    with pytest.raises(ValueError, match="INVALID_TABLE"):
        list_inventory(stock, "WH-TOKYO", "other")
    with pytest.raises(ValueError, match="UNSUPPORTED_SEARCH"):
        list_inventory(stock, "WH-TOKYO", "bad", "location", prefix="A-")
    plain = ids(list_inventory(stock, "WH-TOKYO", "bad").rows)
    assert ids(list_inventory(stock, "WH-TOKYO", "good", "location").rows) == plain
    located = list_inventory(stock, "WH-TOKYO", "good", "location", prefix="C-").rows.collect()
    assert located and all(r["location"].startswith("C-") for r in located)


@pytest.mark.parametrize("start,size", [(0, 20), (35, 20), (250, 300), (590, 20), (5000, 20)])
def test_offset_pages_shallow_and_deep_agree_in_order(stock, start, size):
    order = ["quantity", "item_id", "warehouse_id"]
    every = sorted(tuple(r) for r in stock.select(*order).collect())
    for depth in (10_000, 0):
        page = offset_page(stock, order, start, size, top_k_depth=depth).select(*order)
        assert [tuple(r) for r in page.collect()] == every[start:start + size]


def test_deep_pages_with_null_and_repeated_keys(spark):
    rows = [(None if i % 5 == 0 else i % 7, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int")
    every = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for start in (0, 30, 100, 190):
        got = [tuple(r) for r in offset_page(df, ["a", "b"], start, 15, top_k_depth=0).collect()]
        assert got == every[start:start + 15]


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_text_bounds_reach_the_files(spark, stock, tmp_path):
    from depotlens.sources.catalogue import write_layouts

    stored = spark.read.parquet(write_layouts(stock, str(tmp_path))["by_item"])
    for low, high, pushed in (("905", "990", (905, 990)), ("905.5", "990.5", (906, 990))):
        found = search(stored, Criteria.parse({"min_price": low, "max_price": high}))
        plan = found._jdf.queryExecution().toString()
        assert f"GreaterThanOrEqual(unit_price,{pushed[0]})" in plan and f"LessThanOrEqual(unit_price,{pushed[1]})" in plan
        assert found.count() == stock.filter(f"unit_price BETWEEN {low} AND {high}").count()
    assert search(stored, Criteria.parse({"min_price": "Infinity"})).count() == 0
    assert search(stored, Criteria.parse({"max_price": "Infinity", "min_quantity": "-Infinity"})).count() == stock.count()


def test_page_and_token_come_from_one_read(spark, stock, tmp_path):
    stock.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    page = ordered_page(stored, "unit_price")
    both = page.with_token()
    assert _scans(both) == 1
    found = both.collect()
    assert ids(page.rows) == [(r["item_id"], r["warehouse_id"]) for r in found]
    assert {r["next_token"] for r in found} == {page.next_token()}


@pytest.mark.parametrize("by", [
    {}, {"search_by": "itemPrefix", "prefix": "ITEM#K"}, {"search_by": "location", "prefix": "C-"},
    {"search_by": "unitPrice", "min_price": 904, "max_price": 950}, {"search_by": "unitPrice", "min_price": 904},
])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_listing_over_views_equals_listing(spark, stock, listed_views, by, order):
    token = None
    for _ in range(3):
        want = list_inventory(stock, "WH-OSAKA", "good", order=order, token=token, size=7, **by)
        got = list_inventory_views(listed_views, "WH-OSAKA", "good", order=order, token=token, size=7, **by)
        assert ids(got.rows) == ids(want.rows)
        token = want.next_token()
        assert got.next_token() == token
        if token is None:
            break


@pytest.fixture(scope="module")
def listed_views(spark, stock, tmp_path_factory):
    from depotlens.sources.catalogue import write_layouts
    from depotlens.sources.views import open_views

    path = str(tmp_path_factory.mktemp("views"))
    write_layouts(stock, path, files=6)
    return open_views(spark, path)


def test_relevance_page_walks_all_matches(stock):
    from depotlens.operators.ranking import relevance_search

    criteria = Criteria(item_name="red ring", min_price=905)
    total = search(stock, criteria).count()
    seen = []
    for start in range(0, total + 7, 7):
        page = relevance_search(stock, criteria, start=start, size=7).collect()
        assert {r["total"] for r in page} <= {total}
        seen += [(-r["score"], r["item_id"], r["warehouse_id"]) for r in page]
    assert len(seen) == total and seen == sorted(seen)
    assert relevance_search(stock, Criteria("WH-TOKYO"), size=3).first()["score"] == 0.0


def test_page_info_of_nothing(stock):
    info = page_info(stock.filter("false")).first()
    assert (info["total"], info["page_number"], info["page_count"]) == (0, 1, 1)


def test_any_group_equals_union(stock):
    groups = [Criteria(item_prefix="ITEM#KEN-"), Criteria("WH-TOKYO", min_price=910)]
    want = {i for g in groups for i in ids(search(stock, g))}
    assert sorted(ids(search_any(stock, groups))) == sorted(want)


def test_mode_presence_counts_substring_only_hits(spark):
    rows = [("WH-TOKYO", f"I{i:02d}", "redwood bolt" if i == 0 else "red bolt" if i < 30 else "nut", 1, "A", 5)
            for i in range(40)]
    df = spark.createDataFrame(rows, "warehouse_id string, item_id string, item_name string, quantity long, location string, unit_price long")
    got = mode_summary(compare_modes(df, Criteria("WH-TOKYO", item_name="red"))).first()
    assert (got["complete_hits"], got["capped_hits"], got["in_both"]) == (29, 20, 19)
    assert got["recall"] == round(19 / 29, 6)


def test_point_read_and_coverage(spark, stock):
    one = stock.orderBy("item_id").first()
    assert get_item(stock, one["warehouse_id"], one["item_id"]).count() == 1
    assert get_item(stock, one["warehouse_id"], "ITEM#NONE").count() == 0
    probe = spark.createDataFrame([(one["item_id"],), ("ITEM#NONE",), (one["item_id"],)], "item_id string")
    assert coverage(probe, stock, ["item_id"]).first().asDict() == {
        "probe_keys": 2, "covered_keys": 1, "covered_share": 0.5}
    none = coverage(probe.filter(F.lit(False)), stock, ["item_id"]).first()
    assert (none["probe_keys"], none["covered_share"]) == (0, 0.0)


def test_point_lookups_do_not_broadcast_the_stock(spark, sf):
    from depotlens.plans import QUERIES

    plan = QUERIES["flt_2_point_lookups"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
