"""Edit similarity of near duplicates against the full table, and what the candidate search finds of it."""

from __future__ import annotations

import random

import brute
import pytest

from depotlens.llm import near_dedup
from depotlens.llm.shingles import word_hashes

WORDS = [f"w{i}" for i in range(4_000)]


def edited(rng, words, rate):
    out = list(words)
    for i in rng.sample(range(len(words)), round(rate * len(words))):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_similarity_equals_the_full_table():
    rng = random.Random(4)
    links = 0
    for _ in range(300):
        n = rng.choice([1, 3, 8, 40, 150, 300])
        a = [rng.choice(WORDS) if rng.random() < .7 else rng.choice("abc") for _ in range(n)]
        b = list(a)
        for _ in range(int(rng.choice([.02, .1, .18, .2, .22, .3]) * n)):
            kind, i = rng.random(), rng.randrange(len(b))
            if kind < .5:
                b[i] = rng.choice(WORDS)
            elif kind < .75 and len(b) > 1:
                del b[i]
            else:
                b.insert(i, rng.choice(WORDS))
        if rng.random() < .15:
            b = b[len(b) // 9:] + b[:len(b) // 9]
        want = brute.edit_similarity(a, b)
        want = want if want >= .8 - 1e-9 else 0
        found = near_dedup.similarity(word_hashes(" ".join(a)), word_hashes(" ".join(b)))
        assert (found > 0) == (want > 0) and found <= want + 1e-9
        links += want > 0
    assert 100 < links < 290


def test_long_stretches_without_a_common_shingle_stay_links(spark):
    rng = random.Random(6)
    texts = []
    for pair in range(20):
        a = [rng.choice(WORDS) for _ in range(400)]
        b = [f"z{pair}x{i}" if i >= 200 and i % 5 == 0 else w for i, w in enumerate(a)]
        texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(20)) >= 19


def test_recall_up_to_the_threshold(spark):
    rng = random.Random(12)
    texts, rates = [], (0.05, 0.10, 0.15, 0.18)
    for rate in rates:
        for _ in range(60):
            a = [rng.choice(WORDS) for _ in range(300)]
            texts += [" ".join(a), " ".join(edited(rng, a, rate))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    recall = {rate: sum(found[2 * i + 1] == found[2 * i] for i in range(60 * k, 60 * k + 60)) / 60 for k, rate in enumerate(rates)}
    print("recall", recall)
    assert min(recall.values()) >= 0.9, recall


@pytest.mark.parametrize("most", [0, 1, 5, 40])
def test_bounded_distance(most):
    rng = random.Random(most)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        want = round((1 - brute.edit_similarity(a, b)) * max(len(a), len(b))) if a or b else 0
        found = near_dedup.banded(word_hashes(" ".join(a)), word_hashes(" ".join(b)), most)
        assert found == want if want <= most else found > most
