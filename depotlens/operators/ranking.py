"""Relevance order for text search (textbook BM25)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from depotlens.functions.scalar import query_tokens, tokens
from depotlens.operators.search import Criteria, all_of
from depotlens.schemas import PAGE_SIZE, PRIMARY_KEY
from depotlens.session import written_table


def _occurrences(words: str, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def relevance_search(
    df: DataFrame, criteria: Criteria, keys: Sequence[str] = PRIMARY_KEY, start: int = 0, size: int = PAGE_SIZE,
    text: str = "item_name", k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """One page of a complete search, best match of the name first: rows, ``score`` and ``total``.

    Without a name every score is 0 and the keys give the order.  The statistics
    of the collection cover the whole table, whatever the other criteria are.
    Two passes: one reads the text column and counts, the other keeps a top-k of
    whole rows.
    """
    terms = query_tokens(criteria.item_name or "")
    met = all_of(list(criteria.conditions("complete").values()))
    words = tokens(F.col(text))
    tf = [F.size(words) - F.size(F.array_remove(words, term)) for term in terms]
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(words)), F.lit(0)).alias("length"),
        F.count_if(met).alias("total"), *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)],
    ).first()
    score = F.lit(0.0)
    if terms and counted["length"]:
        norm = k1 * (F.lit(1 - b) + b * F.size(words) / (counted["length"] / counted["n"]))
        for i, t in enumerate(tf):
            found = counted[f"df{i}"]
            idf = F.log(F.lit(1.0 + (counted["n"] - found + 0.5) / (found + 0.5)))
            score = score + idf * t * (k1 + 1) / (t + norm)
    scored = df.filter(met).withColumn("score", F.round(score, 6))
    page = scored.orderBy(F.desc("score"), *keys).offset(start).limit(size)
    return page.withColumn("total", F.lit(counted["total"]).cast("bigint"))


def ranked_search(
    docs: DataFrame, key: str, text: str, query: str, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The ``k`` best documents for any of the query tokens, ties by key.

    Texts are read and cut into tokens once.  That pass counts the query terms
    inside each row, observes the collection statistics on the way, and keeps a
    few numbers per matching document; no text is exploded or shuffled.  Scores
    and a top-k follow on those numbers.
    """
    terms = query_tokens(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    tf = [f"tf{i}" for i in range(len(terms))]
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    counted = words.select(
        key,
        F.size("words").alias("length"),
        *[_occurrences("words", term).alias(name) for name, term in zip(tf, terms)],
    )
    collection = Observation()
    observed = counted.observe(
        collection,
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("length"),
        *[F.count_if(F.col(name) > 0).alias(name) for name in tf],
    )
    matched = written_table(observed.filter(F.greatest(F.lit(0), *tf) > 0), "matches")
    total = collection.get
    if not total["n"]:
        return matched.select(key, F.lit(0.0).alias("score"))
    mean_length = total["length"] / total["n"]
    norm = k1 * (F.lit(1 - b) + b * F.col("length") / mean_length)
    score = F.lit(0.0)
    for name in tf:
        n, found = total["n"], total[name]
        idf = F.log(F.lit(1.0 + (n - found + 0.5) / (found + 0.5)))
        score = score + idf * F.col(name) * (k1 + 1) / (F.col(name) + norm)
    return (
        matched.select(key, F.round(score, 6).alias("score"))
        .orderBy(F.desc("score"), key).limit(k)
    )
