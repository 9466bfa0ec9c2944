import math
import random
from collections import Counter

from pyspark.sql import functions as F

from depotlens.functions.scalar import query_tokens
from depotlens.operators.ranking import ranked_search


def bm25(texts, query, k1=1.2, b=0.75):
    words = {i: Counter(query_tokens_all(t)) for i, t in texts.items()}
    mean = sum(sum(w.values()) for w in words.values()) / len(words)
    scores = {}
    for i, w in words.items():
        total, length = 0.0, sum(w.values())
        for term in query_tokens(query):
            found = sum(term in other for other in words.values())
            idf = math.log(1 + (len(words) - found + 0.5) / (found + 0.5))
            total += idf * w[term] * (k1 + 1) / (w[term] + k1 * (1 - b + b * length / mean))
        if any(w[t] for t in query_tokens(query)):
            scores[i] = round(total, 6)
    return scores


def query_tokens_all(text):
    import re

    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def test_scores_equal_the_formula(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choices(["red", "bolt", "Ring", "nut", "old-gear"], k=rng.randint(0, 30))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    want = bm25(texts, "Red gear red")
    got = {r["id"]: r["score"] for r in ranked_search(df, "id", "body", "Red gear red", 100).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 2e-6 for i in want)
    top = ranked_search(df, "id", "body", "Red gear", 5).collect()
    assert [r["id"] for r in top] == sorted(want, key=lambda i: (-bm25(texts, "Red gear")[i], i))[:5]


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([(1, "red"), (2, None)], "id long, body string")
    assert ranked_search(df, "id", "body", " -- ", 5).count() == 0
    assert ranked_search(df, "id", "body", "blue", 5).count() == 0
    assert ranked_search(df.filter(F.lit(False)), "id", "body", "red", 5).count() == 0
    assert [r["id"] for r in ranked_search(df, "id", "body", "red", 5).collect()] == [1]
