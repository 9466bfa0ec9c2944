"""Outcome classes and request checks: the first failing rule wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.schemas import VARIANTS, WAREHOUSES

# Error names that mean "throttled", by who counts.
THROTTLE_NAMES = {
    "load": (
        "ProvisionedThroughputExceededException", "ThrottlingException", "RequestLimitExceeded",
    ),
    "impact": ("ProvisionedThroughputExceededException", "ThrottlingException"),
    "script": ("ProvisionedThroughputExceededException",),
}


def classify(df: DataFrame, ruleset: str, error: str = "error_name", into: str = "status") -> DataFrame:
    """Adds the outcome of each request.

    load:   throttle names, everything else is a success
    impact: throttle names, no error or a failed stock condition is a success, the rest errors
    script: one throttle name, no error is a success, the rest is counted nowhere (NULL)
    """
    name = F.col(error)
    throttled = F.coalesce(name.isin(*THROTTLE_NAMES[ruleset]), F.lit(False))
    outcome = F.when(throttled, F.lit("throttled"))
    if ruleset == "load":
        outcome = outcome.otherwise("success")
    elif ruleset == "impact":
        served = name.isNull() | (name == "ConditionalCheckFailedException")
        outcome = outcome.when(served, "success").otherwise("error")
    else:
        outcome = outcome.when(name.isNull(), "success")
    return df.withColumn(into, outcome)


def _first_failure(rules: list[tuple[Column, Column]]) -> Column:
    """Message of the first rule whose test is not true; NULL when all hold."""
    return reduce(
        lambda chain, rule: chain.when(~F.coalesce(rule[0], F.lit(False)), rule[1]),
        rules[1:],
        F.when(~F.coalesce(rules[0][0], F.lit(False)), rules[0][1]),
    )


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


# The messages of failed checks, as users see them.
UNREADABLE = "Invalid JSON in request body"
NO_WAREHOUSE = "warehouseId is required and must be a string"
NO_ITEM = "itemId is required and must be a string"
NO_QUANTITY = "quantity is required and must be a positive number"
IMPACT_RATE = "requestsPerSecond is required and must be between 1 and 200"
IMPACT_DURATION = "durationSeconds is required and must be between 1 and 60"
IMPACT_ROUNDS = "iterations must be an integer between 1 and 12"
IMPACT_TOTAL = "iterations * durationSeconds must not exceed 240 seconds"
LOAD_DURATION = "durationSeconds is required and must be a number between 1 and 300"
LOAD_RATE = "requestsPerSecond is required and must be a number between 1 and 4000"
NO_SHARES = "warehouseDistribution is required and must be an object"
SHARES_TOTAL = "warehouseDistribution values must sum to approximately 1.0"
_TABLE_MESSAGE = 'table is required and must be "bad", "good", "goodGsi" or "badOnDemand"'


def _verdict(df: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    message = _first_failure(rules)
    return df.withColumn("message", message).withColumn(
        "code", F.when(F.col("message").isNotNull(), "INVALID_REQUEST")
    )


def parse_ship_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Fields of JSON request texts.  A field of the wrong type reads as missing.

    ``readable`` is false where the text is not JSON.
    """
    value = F.try_parse_json(body)

    def field(path: str, kinds: str, to: str) -> Column:
        kind = F.schema_of_variant(F.variant_get(value, path, "variant"))
        return F.when(kind.rlike(f"^({kinds})"), F.try_variant_get(value, path, to))

    numbers = "BIGINT|DECIMAL|DOUBLE|FLOAT"
    return df.withColumns({
        "readable": value.isNotNull(),
        "warehouse_id": field("$.warehouseId", "STRING", "string"),
        "item_id": field("$.itemId", "STRING", "string"),
        "quantity": field("$.quantity", numbers, "double"),
        "variant": field("$.table", "STRING", "string"),
    })


def validate_ship(df: DataFrame) -> DataFrame:
    """Adds ``code`` and ``message``; both NULL for a valid ship request."""
    quantity = F.col("quantity").cast("double")
    unread = [(F.col("readable"), F.lit(UNREADABLE))] if "readable" in df.columns else []
    return _verdict(df, [
        *unread,
        (F.col("warehouse_id") != "", F.lit(NO_WAREHOUSE)),
        (F.col("item_id") != "", F.lit(NO_ITEM)),
        ((quantity > 0) & _finite(quantity), F.lit(NO_QUANTITY)),
        (F.col("variant").isin(*VARIANTS), F.lit(_TABLE_MESSAGE)),
    ])


def validate_run(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``code`` and ``message`` to run configurations; kind is "load" or "impact"."""
    duration, rps = F.col("duration_seconds"), F.col("requests_per_second")
    rules = [(F.col("variant").isin(*VARIANTS), F.lit(_TABLE_MESSAGE))]
    if kind == "impact":
        rounds = F.coalesce(F.col("iterations"), F.lit(1.0))
        rules += [
            (_finite(rps) & rps.between(1, 200),
             F.lit(IMPACT_RATE)),
            (_finite(duration) & duration.between(1, 60),
             F.lit(IMPACT_DURATION)),
            ((rounds == F.floor(rounds)) & rounds.between(1, 12),
             F.lit(IMPACT_ROUNDS)),
            (rounds * duration <= 240, F.lit(IMPACT_TOTAL)),
        ]
        return _verdict(df, rules)
    shares = F.col("warehouse_distribution")
    rules += [
        (_finite(duration) & (duration > 0) & (duration <= 300),
         F.lit(LOAD_DURATION)),
        (_finite(rps) & (rps > 0) & (rps <= 4000),
         F.lit(LOAD_RATE)),
        (shares.isNotNull(), F.lit(NO_SHARES)),
    ]
    rules += [
        (_finite(shares[w]) & shares[w].between(0, 1),
         F.lit(f"warehouseDistribution.{w} must be a number between 0.0 and 1.0"))
        for w in WAREHOUSES
    ]
    total = reduce(lambda a, w: a + shares[w], WAREHOUSES[1:], shares[WAREHOUSES[0]])
    rules.append((F.abs(total - 1.0) <= 0.01,
                  F.lit(SHARES_TOTAL)))
    return _verdict(df, rules)


def exact_quantities(valid: DataFrame, scale: int = 6) -> DataFrame:
    """Validated requests with ``quantity`` as a decimal that :func:`~depotlens.operators.ledger.ship_batch` takes.

    Adds ``code`` and ``message`` to those that need more digits, for :func:`split_valid`.
    """
    text = F.col("quantity").cast("string")
    exact = text.try_cast(f"decimal({12 + scale},{scale})")
    fits = exact.isNotNull() & (exact.cast("double") == F.col("quantity").cast("double"))
    message = F.lit(f"quantity must have at most {scale} decimals")
    return valid.withColumns({
        "message": F.when(~fits, message), "code": F.when(~fits, F.lit("INVALID_REQUEST")), "quantity": exact,
    })


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without verdict columns, and the quarantine with them."""
    return (
        checked.filter(F.col("code").isNull()).drop("code", "message"),
        checked.filter(F.col("code").isNotNull()),
    )
