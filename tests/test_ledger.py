import random
from datetime import datetime, timedelta

import pytest

from depotlens.operators import ledger
from depotlens.operators.validation import parse_ship_bodies, split_valid, validate_run, validate_ship

REQUEST = "request_id long, ts timestamp, item_id string, warehouse_id string, quantity long"
STOCK = "item_id string, warehouse_id string, quantity long"
T0 = datetime(2026, 1, 1)


def greedy(stock, requests):
    left = {(i, w): q for i, w, q in stock}
    out = {}
    for rid, _, item, house, quantity in sorted(requests, key=lambda r: (r[1], r[0])):
        have = left.get((item, house), 0)
        fits = 0 < quantity <= have
        left[(item, house)] = have - (quantity if fits else 0)
        out[rid] = (fits, left[(item, house)])
    return out, left


def made(seed, n, keys, top):
    rng = random.Random(seed)
    stock = [(f"I{k}", "W", rng.choice([0, 1, 7, 63, 64, 500, 5000])) for k in range(keys) if k != 1]
    requests = [
        (i, T0 + timedelta(seconds=rng.randrange(n)), f"I{0 if rng.random() < .5 else rng.randrange(keys)}", "W",
         rng.choice([rng.randint(1, 3), rng.randint(1, top), 0, -2, 2 ** rng.randrange(10)]))
        for i in range(n)
    ]
    return stock, requests


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot_rows", [10**9, 150, 0])
def test_equals_one_by_one(spark, seed, hot_rows):
    stock, requests = made(seed, 900, 6, 300)
    want, _ = greedy(stock, requests)
    decided = ledger.ship_batch(
        spark.createDataFrame(stock, STOCK), spark.createDataFrame(requests, REQUEST).repartition(5),
        hot_rows=hot_rows, partitions=7,
    )
    got = {r["request_id"]: (r["accepted"], r["stock_after"]) for r in decided.collect()}
    assert got == want


def test_smaller_request_after_a_rejection_fits(spark):
    stock = spark.createDataFrame([("A", "W", 5)], STOCK)
    asked = [(1, T0, "A", "W", 4), (2, T0, "A", "W", 3), (3, T0, "A", "W", 1), (4, T0, "B", "W", 1)]
    decided = ledger.ship_batch(stock, spark.createDataFrame(asked, REQUEST))
    answers = {r["request_id"]: r for r in ledger.ship_responses(decided).collect()}
    assert [answers[i]["accepted"] for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert answers[2]["message"] == "Insufficient stock. Current: 1, Requested: 3"
    assert answers[4]["message"] == "Insufficient stock. Current: 0, Requested: 1"
    assert answers[1]["code"] is None


def test_closing_stock_balances(spark):
    stock, requests = made(9, 500, 5, 50)
    s, r = spark.createDataFrame(stock, STOCK), spark.createDataFrame(requests, REQUEST)
    decided = ledger.ship_batch(s, r)
    _, left = greedy(stock, requests)
    got = {(x["item_id"], x["warehouse_id"]): x["quantity"] for x in ledger.closing_stock(s, decided).collect()}
    assert got == {(i, w): left[(i, w)] for i, w, _ in stock} and min(got.values()) >= 0


def test_fractions_are_refused(spark):
    stock = spark.createDataFrame([("A", "W", 1.5)], "item_id string, warehouse_id string, quantity double")
    with pytest.raises(TypeError):
        ledger.ship_batch(stock, spark.createDataFrame([(1, T0, "A", "W", 4)], REQUEST))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], REQUEST)
    assert ledger.ship_batch(spark.createDataFrame([("A", "W", 1)], STOCK), none).count() == 0
    assert ledger.ship_batch(spark.createDataFrame([], STOCK), spark.createDataFrame(
        [(1, T0, "A", "W", 4)], REQUEST)).first()["accepted"] is False


def test_ship_rules_in_order(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, None, nan, "x"), ("W", "", 1.0, "bad"), ("W", "I", nan, "bad"), ("W", "I", inf, "bad"),
            ("W", "I", 0.0, "bad"), ("W", "I", -1.0, "bad"), ("W", "I", None, "bad"), ("W", "I", 1.0, None),
            ("W", "I", 0.5, "goodGsi")]
    df = spark.createDataFrame(rows, "warehouse_id string, item_id string, quantity double, variant string")
    starts = [(r["message"] or "").split(" ")[0] for r in validate_ship(df).collect()]
    assert starts == ["warehouseId", "itemId"] + ["quantity"] * 5 + ["table", ""]
    good, bad = split_valid(validate_ship(df))
    assert (good.count(), bad.count()) == (1, 8) and "code" not in good.columns


def test_ship_bodies(spark):
    bodies = ['{"warehouseId"', '[]', '{"warehouseId": 7, "itemId": "I", "quantity": 1, "table": "bad"}',
              '{"warehouseId": "W", "itemId": "I", "quantity": "1", "table": "bad"}',
              '{"warehouseId": "W", "itemId": "I", "quantity": 0.5, "table": "bad"}',
              '{"warehouseId": "W", "itemId": "I", "quantity": 1e2, "table": 1}', None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [(r["message"] or "").split(" ")[0] for r in validate_ship(parse_ship_bodies(df)).orderBy("i").collect()]
    assert got == ["Invalid", "warehouseId", "warehouseId", "quantity", "", "table", "Invalid"]


def test_run_rules(spark):
    schema = ("variant string, duration_seconds double, requests_per_second double, iterations double, "
              "warehouse_distribution map<string,double>")
    even = {"WH-TOKYO": 0.8, "WH-OSAKA": 0.1, "WH-FUKUOKA": 0.1}
    rows = [
        ("bad", 300.0, 4000.0, None, even), ("bad", 301.0, 10.0, None, even), ("bad", 10.0, 4001.0, None, even),
        ("bad", 10.0, 10.0, None, None), ("bad", 10.0, 10.0, None, {"WH-TOKYO": 1.0}),
        ("bad", 10.0, 10.0, None, {**even, "WH-OSAKA": 0.115}), ("bad", 10.0, 10.0, None, {**even, "WH-OSAKA": 0.105}),
    ]
    got = [(r["message"] or "").split(" ")[0] for r in validate_run(spark.createDataFrame(rows, schema), "load").collect()]
    assert got == ["", "durationSeconds", "requestsPerSecond", "warehouseDistribution",
                   "warehouseDistribution.WH-OSAKA", "warehouseDistribution", ""]
    rows = [("good", 20.0, 200.0, 12.0, None), ("good", 20.0, 200.0, None, None), ("good", 21.0, 200.0, 12.0, None),
            ("good", 20.0, 200.0, 1.5, None), ("good", 20.0, 201.0, 1.0, None), ("good", 0.5, 1.0, 1.0, None)]
    got = [(r["message"] or "").split(" ")[0] for r in validate_run(spark.createDataFrame(rows, schema), "impact").collect()]
    assert got == ["", "", "iterations", "iterations", "requestsPerSecond", "durationSeconds"]


def test_bump_counts_without_condition(spark):
    base = spark.createDataFrame([("a", 5), ("b", None)], "k string, counter long")
    events = spark.createDataFrame([("a",), ("a",), ("c",)], "k string")
    got = {r["k"]: r["counter"] for r in ledger.bump(base, events, ["k"]).collect()}
    assert got == {"a": 7, "b": 0, "c": 1}


def test_fractions_are_decided_exactly(spark):
    from decimal import Decimal

    stock = spark.createDataFrame([("A", "W", 1)], "item_id string, warehouse_id string, quantity long")
    asked = spark.createDataFrame(
        [(i, "A", "W", Decimal(q)) for i, q in enumerate(["0.1", "0.2", "0.7", "0.05", "0.000001"])],
        "request_id long, item_id string, warehouse_id string, quantity decimal(18,6)")
    for hot_rows in (10, 2):
        got = ledger.ship_batch(stock, asked, order=["request_id"], hot_rows=hot_rows).orderBy("request_id").collect()
        assert [r["accepted"] for r in got] == [True, True, True, False, False]
        assert [r["stock_after"] for r in got] == [Decimal("0.9"), Decimal("0.7"), 0, 0, 0]


def test_bodies_flow_into_the_stock(spark):
    from depotlens.operators import validation

    bodies = [
        '{"warehouseId": "W", "itemId": "A", "quantity": 0.5, "table": "good"}', '{"warehouseId": "W"}', "nonsense",
        '{"warehouseId": "W", "itemId": "A", "quantity": 0.12345678, "table": "good"}',
        '{"warehouseId": "W", "itemId": "A", "quantity": 2, "table": "bad"}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    valid, bad = validation.split_valid(validation.validate_ship(validation.parse_ship_bodies(df)))
    exact, inexact = validation.split_valid(validation.exact_quantities(valid))
    assert {r["request_id"] for r in bad.collect()} == {1, 2} and [r["request_id"] for r in inexact.collect()] == [3]
    stock = spark.createDataFrame([("A", "W", 2)], "item_id string, warehouse_id string, quantity long")
    got = ledger.ship_batch(stock, exact.select("request_id", "item_id", "warehouse_id", "quantity"), order=["request_id"])
    assert {r["request_id"]: r["accepted"] for r in got.collect()} == {0: True, 4: False}


def test_bodies_are_parsed_once(spark, sf):
    from depotlens.plans import QUERIES

    plan = QUERIES["val_1_bodies_to_stock"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_get" not in plan and "parse_json" not in plan
