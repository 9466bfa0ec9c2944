"""The ten operators against plain versions, and their awkward cases."""

from __future__ import annotations

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.llm import (
    decontamination, license_scan, mixing, near_dedup, pii, quality_classifier, quality_rules, queries, sharding,
    suffix_dedup, token_output,
)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 1. sharding

def test_shards_balance_and_slots_are_gapless(spark, sf, texts):
    found = rows(queries.op1_sharding(spark, sf))
    assert len(found) == len(texts)
    sizes, slots, largest = Counter(), defaultdict(list), 0
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        largest = max(largest, r["size"])
    mean = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and max(abs(s - mean) for s in sizes.values()) <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows(queries.op1_sharding(spark, sf))) == sorted(
        (r["doc_id"], r["shard"], r["slot"]) for r in found)


def test_a_hot_text_is_cut_and_small_groups_stay_whole(spark):
    data = [(i, "hot text" if i % 3 == 0 else f"text {i // 2} " * 5) for i in range(3000)]
    found = rows(sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string"), 8, samples_per_range=4))
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(abs(s - mean) for s in sizes.values()) <= max(r["size"] for r in found)
    assert len({r["shard"] for r in found if r["text"] == "hot text"}) > 1


def test_sharding_odd_and_empty(odd, empty):
    found = rows(sharding.shard_documents(odd, 3))
    assert len(found) == odd.count() and {r["record"] for r in found} == {"clash"}
    assert {r["size"] for r in found if r["doc_id"] in (1, 2)} == {8}
    assert sorted((r["shard"], r["slot"]) for r in found) == sorted({(r["shard"], r["slot"]) for r in found})
    assert rows(sharding.shard_documents(empty, 3)) == []


# 2. near duplicates

def test_classes_equal_all_pairs(spark, sf, texts):
    found = {r["doc_id"]: r["class_id"] for r in rows(queries.op2_near_dedup(spark, sf))}
    assert found == brute.classes(texts)


def test_near_copies_in_a_crowd_that_shares_a_passage(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(120)]
    data = []
    for i in range(60):
        own = passage + [word() for _ in range(50)]
        data.append((2 * i, " ".join(own)))
        if i % 4 == 0:
            changed = list(own)
            changed[-7] = "edited"
            data.append((2 * i + 1, " ".join(changed)))
    texts = dict(data)
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in rows(found)} == brute.classes(texts)


def _random_words(seed):
    dice = random.Random(seed)
    return dice, lambda n: ["".join(dice.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def test_alike_texts_behind_a_crowd_of_unlike_ones(spark):
    _, words = _random_words(11)
    passage = words(195)
    data = [(i, " ".join(passage + words(63 if i < 100 else 23))) for i in range(160)]
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in rows(found)} == {i: min(i, 100) for i in range(160)}


def test_an_original_in_the_middle_joins_its_variants(spark):
    dice, words = _random_words(12)
    original = words(200)
    data = [(150, " ".join(original))]
    for i in [*range(150), *range(151, 300)]:
        at = dice.randrange(10, 190)
        data.append((i, " ".join(original[:at] + words(40) + original[at:])))
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["class_id"] for r in rows(found)} == {0}


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    test_alike_texts_behind_a_crowd_of_unlike_ones(spark)


def test_a_crowd_holds_every_text_once(spark, monkeypatch):
    """Unlike texts around one passage share many sketches; they met in every bucket of theirs before."""
    _, words = _random_words(13)
    passage = words(150)
    data = [(i, " ".join(passage + words(50))) for i in range(120)]
    rows_seen, blocks = spark.sparkContext.accumulator(0), near_dedup._blocks_compared

    def counting(most):
        real = blocks(most)

        def run(batches):
            def seen():
                for batch in batches:
                    rows_seen.add(batch.num_rows)
                    yield batch

            yield from real(seen())

        return run

    monkeypatch.setattr(near_dedup, "_blocks_compared", counting)
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in rows(found)} == brute.classes(dict(data))
    assert 120 <= rows_seen.value <= 30 * 120


def test_order_matters_to_the_alignment():
    words = np.arange(1, 400, dtype=np.uint64)
    assert near_dedup.similarity(words, words) == 1.0
    assert near_dedup.similarity(words, np.roll(words, 200)) == 0.0
    assert near_dedup.similarity(words, np.concatenate([words[:370], words[:20] + np.uint64(9999)])) > 0.8


def test_near_duplicates_odd_and_empty(odd, empty):
    found = near_dedup.near_duplicates(odd)
    classes = Counter((r["doc_id"], r["class_id"]) for r in rows(found))
    assert classes == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 4): 2, (None, None): 1, (7, 7): 1,
                               (8, 8): 1, (9, 9): 1})
    kept = near_dedup.keep_one_of_each(odd, found)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter([1, 2, 3, 4, None, 7, 8, 9])
    assert rows(near_dedup.near_duplicates(empty)) == []


def test_one_row_of_repeated_rows_stays(spark):
    data = spark.createDataFrame([(3, "a b c d e f g"), (3, "a b c d e f g"), (4, "A, b c d e f g")], "doc_id long, text string")
    assert [r["doc_id"] for r in rows(near_dedup.keep_one_of_each(data, near_dedup.near_duplicates(data)))] == [3]


# 3. mixing

def test_mix_reaches_its_targets(spark, sf, docs, texts):
    found = rows(queries.op3_mixing(spark, sf))
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes = Counter()
    for i, t in texts.items():
        sizes[source[i]] += len(brute.WORD.findall(t))
    wanted = brute.targets(dict(sizes))
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == len(brute.WORD.findall(texts[r["doc_id"]])) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(wanted[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(found) == len(texts) and all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)
    assert sorted(map(str, rows(queries.op3_mixing(spark, sf)))) == sorted(map(str, found))


def test_schedule_keeps_the_weights_everywhere(spark):
    quotas = mixing._quotas(
        spark.createDataFrame([("a", 0, 60_000, 50_000.0), ("b", 1, 30_000, 60_000.0)],
                              "source string, sid int, source_size long, target double"), 100)
    order = [r["sid"] for r in sorted(rows(mixing.schedule(quotas)), key=lambda r: r["slot"])]
    assert Counter(order) == {0: 500, 1: 600}
    for begin in range(0, 1000, 100):
        assert abs(order[begin:begin + 100].count(0) - 100 * 5 / 11) < 5
    ranks = defaultdict(list)
    for r in rows(mixing.schedule(quotas)):
        ranks[r["sid"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_mixed_rows_repeat_documents(spark, docs, texts):
    taken, slots = mixing.mix_sources(docs, floor=1.0, block=256)
    number = {r["doc_id"]: (r["taken"], r["size"]) for r in rows(taken)}
    mixed = mixing.mixed_documents(docs, taken)
    assert mixed.columns == docs.columns
    copies = defaultdict(list)
    for r in rows(mixed):
        copies[r["doc_id"]].append(r["text"])
    cut = 0
    for i, (words, size) in number.items():
        assert size <= words <= 2 * size
        assert copies[i].count(texts[i]) == words // size
        rest = [t for t in copies[i] if t != texts[i]]
        assert [len(t.split(" ")) for t in rest] == ([words % size] if words % size else [])
        cut += len(rest)
    assert cut <= 20 and sum(w for w, _ in number.values()) == sum(
        len(brute.WORD.findall(t)) for found in copies.values() for t in found)
    assert slots.count() == slots.select("slot", "sid", "block").distinct().count()


def test_mixing_odd_and_empty(odd, empty):
    taken, _ = mixing.mix_sources(odd)
    found = rows(taken)
    assert len(found) == odd.count()
    assert {r["taken"] for r in found if r["size"] == 0} == {0}
    assert sum(r["size"] for r in found if r["doc_id"] == 5) == 4
    mixed = mixing.mixed_documents(odd, taken)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert rows(mixing.mix_sources(empty)[0]) == []


# 4. decontamination

def test_leaks_equal_all_windows(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows(queries.op4_decontamination(spark, sf))}
    assert found and found == brute.leaks(texts, items)


def test_edited_passages_and_small_items(spark):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(6))
    items, data = {}, []
    for j in range(40):
        words = [word() for _ in range(dice.choice([2, 4, 6, 12, 30, 70, 150]))]
        items[j] = " ".join(words)
        edited = list(words)
        for _ in range(len(words) // 40):
            at = dice.randrange(len(edited))
            edited[at:at + 1] = dice.choice([["changed"], [], [edited[at], "added"]])
        around = [word() for _ in range(100)]
        data.append((j, " ".join(around[:50] + edited + around[50:])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in rows(decontamination.benchmark_leaks(docs, bench))}
    assert found >= brute.leaks(dict(data), items) and {j for _, j in found} <= set(items)
    assert all(i == j for i, j in found)


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for within in (3, 7):
        near = prints.copy()
        for i in range(len(near)):
            for bit in rng.choice(64, i % (within + 3), replace=False):
                near[i] ^= np.uint64(1) << np.uint64(bit)
        w, p = decontamination.BlockIndex(prints, within).search(near)
        far = np.bitwise_count(near[:, None] ^ prints[None, :])
        assert set(zip(w.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= within))))


def test_decontamination_odd_empty_and_in_blocks(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short text"), (None, "x"), (4, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10")],
                                  "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in rows(decontamination.benchmark_leaks(odd, bench)))
    assert found == [(3, 4), (4, 3), (5, 3), (5, 3)]
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    assert sorted((r["doc_id"], r["item_id"]) for r in rows(decontamination.benchmark_leaks(odd, bench))) == found
    clean = decontamination.decontaminate(odd, bench)
    assert clean.columns == odd.columns and {r["doc_id"] for r in rows(clean)} == {1, 2, None, 7, 8, 9}
    assert rows(decontamination.benchmark_leaks(empty, bench)) == []
    assert rows(decontamination.benchmark_leaks(odd, bench.limit(0))) == []


# 5. licence scan

def test_base_places_equal_a_plain_search(spark, sf, texts):
    for r in rows(queries.op5_license_scan(spark, sf)):
        n, places = brute.base_places(texts[r["doc_id"]])
        at = [i for i, _ in places]
        base = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(base) and set(base) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (not base or r["score"] > 0)


def test_automaton_statistics_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sequences = [rng.integers(1, 4, rng.integers(1, 9)).tolist() for _ in range(3)]
        automaton = license_scan.SuffixAutomaton(sequences)
        query = rng.integers(1, 5, 30).tolist()
        for i, (length, state) in enumerate(automaton.statistics(query)):
            def holds(k, s):
                return any(s[a:a + k] == query[i + 1 - k:i + 1] for a in range(len(s) - k + 1))
            assert length == max(k for k in range(i + 2) if k == 0 or any(holds(k, s) for s in sequences))
            if length:
                assert set(automaton.states[state].ends) == {n for n, s in enumerate(sequences) if holds(length, s)}


def test_long_templates_survive_edits():
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.PHRASES)
    text = license_scan.TEMPLATES[1][1].replace("merge, publish", "join, publish").upper()
    found = scanner.scan("Some code. " + text + " and the rest")
    assert found["labels"] == "mit" and found["n_base"] == 0 and 0.8 < found["score"] < 1
    assert scanner.scan("the rights to use the software")["labels"] == ""


def test_segments_do_not_change_a_scan(monkeypatch):
    scanner = license_scan.LicenseScanner(license_scan.TEMPLATES, license_scan.PHRASES)
    text = "über MIT License, Apache-License; " * 50 + "Released under the MIT License"
    whole = scanner.scan(text)
    monkeypatch.setattr(license_scan, "SEGMENT", 7)
    assert scanner.scan(text) == whole and whole["n_base"] == 101


def test_license_scan_odd_and_empty(odd, empty):
    found = rows(license_scan.scan_licenses(odd))
    assert len(found) == odd.count()
    assert [(r["n_words"], r["first_word"], r["labels"], r["score"]) for r in found if r["doc_id"] in (1, 2)] == [(0, None, "", 0.0)] * 2
    assert rows(license_scan.scan_licenses(empty)) == []


# 6. suffix dedup

def _repeats(found):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)


def test_repeats_equal_brute_force(spark, sf, texts):
    ids = sorted(texts)
    wanted = [(i, *r) for i, r in zip(ids, brute.repeats([texts[i] for i in ids]))]
    found = queries.op6_suffix_dedup(spark, sf)
    assert _repeats(rows(found)) == wanted and sum(r[2] for r in wanted) > 0


@pytest.mark.parametrize("hot", [2, 20_000])
def test_planted_repeats_in_columns_and_by_counts(spark, hot):
    rng = np.random.default_rng(4)
    random_text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    p, q, short, edge = random_text(450), random_text(1300), random_text(399), random_text(400)
    data = ["x" * 900, "ab" * 500, p + "1" + q, q + "2" + p + short, short + "3", edge, edge + "!", "é" * 300 + p,
            q[:700] + random_text(50) + q[650:], p, p, None, "", short, short]
    wanted = [(i, *r) for i, r in enumerate(brute.repeats(data))]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    assert _repeats(rows(suffix_dedup.remove_repeats(docs, hot=hot, batch=4))) == wanted


def test_periodic_texts_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    random_text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    unit, other = random_text(7), random_text(150)
    data = ["z" * 400, "z" * 401 + random_text(60), unit * 90, "q" + unit * 57 + "q", unit * 58, other * 9,
            random_text(30) + other * 3 + random_text(30), "y" * 399 + "!" + "y" * 399, "y" * 400, "v" * 401,
            (unit * 60 + "-" + other * 4) * 2]
    wanted = [(i, *r) for i, r in enumerate(brute.repeats(data))]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    for hot in (2, 20_000):
        assert _repeats(rows(suffix_dedup.remove_repeats(docs, hot=hot, batch=4))) == wanted


def test_long_periodic_texts_have_few_anchors(spark):
    for text in ("x" * 1_000_000, "0123456789" * 100_000):
        (at, *_), runs = suffix_dedup.anchors_and_runs(np.frombuffer(text.encode(), np.uint8))
        assert len(at) <= 10 and runs == [(0, len(text))]
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "x" * 400 + "y"), (3, "a b" * 9)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(suffix_dedup.remove_repeats(docs))}
    assert [found[i]["n_removed"] for i in (1, 2, 3)] == [1_000_000, 400, 0]
    assert [(s["begin"], s["end"]) for s in found[2]["spans"]] == [(0, 400)]


def test_planted_passages_across_documents_show_as_spans(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 1 << 40, n))
    passages, shorter = [words(60) for _ in range(6)], [words(60)[:399] for _ in range(6)]
    data, planted = [], []
    for k in range(36):
        passage = passages[k % 6] if k < 18 else shorter[k % 6] if k < 30 else ""
        mark = chr(65 + k)  # differs in every document, so no match goes beyond the passage
        before = words(30) + mark if k % 3 else ""
        data.append((k, before + passage + mark + words(40)))
        planted.append([(len(before), len(before) + len(passage))] if k < 18 else [])
    found = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]]
             for r in rows(suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")))}
    assert all(len(p) >= 400 for p in passages)
    assert [found[k] for k in range(36)] == planted


def _shuffled_bytes(spark):
    """Bytes that every stage so far has written for other stages."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(
        none, False, False, gateway.new_array(jvm.double, 0), none).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_texts_with_repeats_move_once(spark):
    rng = np.random.default_rng(10)
    random_text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passages = [random_text(500) for _ in range(10)]
    data = [(k, random_text(20_000) + chr(65 + k) + passages[k % 10] + chr(65 + k) + random_text(20_000)) for k in range(50)]
    docs = spark.createDataFrame(data, "doc_id long, text string").localCheckpoint()
    setting = "spark.sql.autoBroadcastJoinThreshold"  # a real table is not broadcast
    usual, before = spark.conf.get(setting), _shuffled_bytes(spark)
    spark.conf.set(setting, "-1")
    try:
        found = rows(suffix_dedup.remove_repeats(docs))
    finally:
        spark.conf.set(setting, usual)
    moved = _shuffled_bytes(spark) - before
    assert [r["n_removed"] for r in found] == [500] * 50
    assert moved < 2 * sum(len(text) for _, text in data)  # all texts once, then anchors and strings around shared ones


def test_suffix_dedup_odd_and_empty(odd, empty):
    found = rows(suffix_dedup.remove_repeats(odd))
    assert len(found) == odd.count()
    known = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in found}
    assert known[1] == known[2] == (0, 0) and known[7] == (3000, 3000) and known[5] == (10, 0)
    assert rows(suffix_dedup.remove_repeats(empty)) == []


# 7. quality rules

def test_cascade_order_and_verdict(spark, docs):
    order = quality_rules.rule_order(docs, quality_rules.RULES)
    assert {r.name for r, _, _ in order} == {r.name for r in quality_rules.RULES}
    gains = [share / cost for _, cost, share in order]
    assert gains == sorted(gains, reverse=True)
    short = {r["doc_id"]: r for r in rows(quality_rules.quality_cascade(docs))}
    full = {r["doc_id"]: r for r in rows(quality_rules.quality_cascade(docs, report=True))}
    assert {i: r["kept"] for i, r in short.items()} == {i: r["kept"] for i, r in full.items()}
    assert any(v is None for r in short.values() for v in r["measures"].values())
    assert all(v is not None for r in full.values() for v in r["measures"].values())


def test_cascade_odd_and_empty(odd, empty):
    found = rows(quality_rules.quality_cascade(odd, report=True))
    known = {r["doc_id"]: r for r in found}
    assert len(found) == odd.count() and known[7]["found"] == "clash"
    assert known[1]["measures"]["n_words"] == 0 and not known[1]["kept"] and not known[8]["kept"]
    assert known[3]["measures"]["n_words"] == 60_000 and known[3]["kept"]
    assert known[9]["measures"]["n_repeat_words"] == 120
    assert rows(quality_rules.quality_cascade(empty)) == []


# 8. quality classifier

def test_held_out_quality(spark, sf):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = rows(queries.op8_quality_classifier(spark, sf))
    held = [r for r in found if r["held_out"] and r["doc_id"] in label]
    assert all(r["held_out"] == (brute.crc(str(r["doc_id"])) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) / len(held) > 0.9


def test_held_out_labels_change_nothing(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    flipped = labels.withColumn(
        "quality", F.when(quality_classifier.in_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {r["doc_id"]: r["score"] for r in rows(quality_classifier.quality_scores(docs, labels))}
    two = {r["doc_id"]: r["score"] for r in rows(quality_classifier.quality_scores(docs, flipped))}
    assert one == pytest.approx(two, abs=1e-9)


def test_classifier_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (9, 1), (9, 0), (7, 0), (None, 1), (77, 1), (5, None)], "doc_id long, quality int")
    found = rows(quality_classifier.quality_scores(odd, labels))
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in rows(quality_classifier.quality_scores(odd, labels.limit(0)))} == {0.5}
    assert rows(quality_classifier.quality_scores(empty, labels)) == []


# 9. token files

def _whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.public_vocabulary())
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, sf, texts):
    found = {r["doc_id"]: r for r in rows(queries.op9_token_files(spark, sf))}
    start = 0
    for i, ids in zip(sorted(texts), _whole_ids([texts[i] for i in sorted(texts)])):
        ids = [*ids, 2]
        r = found[i]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_words_encode_like_whole_texts():
    alphabet = "aAéÉ éΣİΑ.,!?'s1漢\x01\n\t\x1c <|endoftext|>#$́क़"
    dice = random.Random(7)
    texts = ["".join(dice.choice(alphabet) for _ in range(dice.randint(0, 40))) for _ in range(3000)]
    texts += ["İ. H̱ ẖ ﬁ ŉ ẞ ª 𝐀𝐁. it's x's. ... ?! don't (a) b) \x85 x"]
    encoder = token_output.WordEncoder(queries.public_vocabulary())
    for text, raw, ids in zip(texts, encoder.encode([t.encode() for t in texts]), _whole_ids(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids, text


def test_more_links_join_only_the_classes_they_touch(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9), (10, 9)], "doc long, label long")
    links = spark.createDataFrame([(6, 2), (11, 12), (2, 1), (12, 3)], "a long, b long")
    sizes, components = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: sizes.append(edges.count()) or components(edges))
    found = {r["doc"]: r["label"] for r in rows(near_dedup.merged(labels, links))}
    assert found == {1: 1, 2: 1, 5: 1, 6: 1, 9: 9, 10: 9, 3: 3, 11: 3, 12: 3}
    assert sizes == [3]  # the link inside a class and the untouched class are left out
    assert near_dedup.merged(labels, links.limit(0)) is labels


def test_a_word_is_encoded_once_whatever_its_case_and_punctuation():
    encoder = token_output.WordEncoder(queries.public_vocabulary())
    text = "Stock stock, STOCK. (stock!) stock?! für für, 3.5"
    raw, = encoder.encode([text.encode()])
    assert np.frombuffer(raw, "<u4").tolist() == _whole_ids([text])[0]
    assert set(encoder.known) <= {"", "stock", "(stock!)", "für", "3.5", ",", ".", "?!"}


def test_files_are_sorted_and_looked_up(spark, docs, tmp_path):
    path = token_output.write_token_files(docs, f"{tmp_path}/t", queries.public_vocabulary())
    stored = token_output.token_files(spark, path)
    by_part = defaultdict(list)
    for r in stored.orderBy("part", "row").select("part", "doc_id").collect():
        by_part[r["part"]].append(r["doc_id"])
    line = [i for part in sorted(by_part) for i in by_part[part]]
    assert line == sorted(line)
    looked_up = token_output.find_documents(spark, path, [3, 77])
    assert sorted(r["doc_id"] for r in rows(looked_up)) == [3, 77]
    assert "PushedFilters: [In(doc_id" in looked_up._jdf.queryExecution().toString()


def test_token_files_odd_and_empty(spark, odd, empty, tmp_path):
    token_output.write_token_files(odd, f"{tmp_path}/odd", queries.public_vocabulary())
    found = rows(token_output.token_digest(spark, f"{tmp_path}/odd"))
    assert len(found) == odd.count()
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert all((r["n_tokens"], r["ids_crc32"]) == (1, end) for r in found if r["doc_id"] in (1, 2, 8))
    assert [r["start"] for r in found if r["doc_id"] is None] == [0]
    token_output.write_token_files(empty, f"{tmp_path}/empty", queries.public_vocabulary())
    assert rows(token_output.token_digest(spark, f"{tmp_path}/empty")) == []


# 10. pseudonyms

KEY = "test key"


def _plain_text(value, kind, key=KEY, letters=26):
    half = len(value) // 2
    a, b = value[:half], value[half:]

    def shifted(text, other, r):
        parts = "|".join([key, kind, str(r), other])
        digest = hashlib.sha512(f"{parts}|0".encode()).hexdigest() + hashlib.sha512(f"{parts}|1".encode()).hexdigest()
        out = ""
        for i, c in enumerate(text):
            by = int(digest[3 * i:3 * i + 3], 16)
            for first, n in ((48, 10), (97, letters), (65, letters)):
                if first <= ord(c) < first + n:
                    c = chr(first + (ord(c) - first + by) % n)
                    break
            out += c
        return out

    for r in range(8):
        if r % 2 == 0:
            b = shifted(b, a, r)
        else:
            a = shifted(a, b, r)
    return a + b


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def test_cards_beside_other_numbers_are_found(spark):
    card = "4111 1111 1111 1111"
    samples = {
        f"{card} 12/27": [card], "4111111111111111 123": ["4111111111111111"], f"7 {card}": [card],
        f"1234 {card} 12/27/2030 and {card} 123-45-6789": [card, "12/27/2030", card, "123-45-6789"],
        f"{card} {card}, 9 {card} 5": [card] * 3, "378282246310005 1 2 3": ["378282246310005"],
        "1 2 3 4 5 6 7 8 9 0 1 2 3 " * 20 + "end": None,
    }
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(pii.pseudonymize(docs, KEY))}
    for i, (text, values) in enumerate(samples.items()):
        if values is None:
            continue
        assert [f["value"] for f in found[i]["found"]] == values
        for f in found[i]["found"]:
            text = text.replace(f["value"], f["pseudonym"])
        assert found[i]["text"] == text


def test_pseudonyms_keep_their_format(spark):
    samples = [
        "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112",
        "mail jane.doe+x@mail.example.com or JANE@x.org; ip 10.0.255.1 not 10.0.256.1 or 1.2.3.4.5",
        "born 1999-02-28, 28.02.1999, 02/28/1999; not 1999-02-30 or 1850-01-01; ssn 123-45-6789 not 000-45-6789",
        "call +1 (017) 555-7713 or (212) 555-0000; token = \"be64439e3e49cf46b2d7c90f3602a3d0b907ff\"; TOKEN=ABCDEFGHIJKLMNOP",
        "nothing here: 12 34, a=b", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(pii.pseudonymize(docs, KEY))}
    by_kind = defaultdict(list)
    for r in found.values():
        for f in r["found"]:
            assert f["value"] in samples[r["doc_id"]] and f["pseudonym"] != f["value"]
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", f["value"]))) == re.sub(
                "[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", f["pseudonym"]))) or f["kind"] == "ip"
            by_kind[f["kind"]].append((f["value"], f["pseudonym"]))
    assert {k: len(v) for k, v in by_kind.items()} == {"card": 2, "email": 2, "ip": 1, "date": 3, "ssn": 1, "phone": 2, "token": 2}
    cards = [re.sub("[^0-9]", "", p) for _, p in by_kind["card"]]
    assert cards[0] == cards[1] and _luhn(cards[0]) == 0 and cards[0][:-1] == _plain_text("411111111111111", "card")
    assert by_kind["email"][0][1] == _plain_text("jane.doe+x", "email") + "@mail.example.com"
    assert all(int(o) < 256 for o in by_kind["ip"][0][1].split("."))
    days = [datetime.datetime.strptime(p, f) for (_, p), f in zip(by_kind["date"], ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"))]
    assert len(set(days)) == 1
    assert by_kind["phone"][0][1].startswith("+1 (")
    assert re.fullmatch('token = "[0-9a-f]{38}', by_kind["token"][0][1])
    assert found[4]["text"] == samples[4] and found[5]["text"] is None and found[6]["text"] == ""
    assert "4111 1111 1111 1112" in found[0]["text"] and "10.0.256.1" in found[1]["text"]
    for i, r in found.items():
        text = samples[i]
        for f in r["found"]:
            text = text.replace(f["value"], f["pseudonym"], 1)
        assert text == r["text"]


def test_number_permutation_is_one_to_one(spark):
    side = 12
    new = pii.permuted_number(F.col("id"), side, F.lit("date"), KEY)
    assert sorted(r[0] for r in spark.range(side * side).select(new).collect()) == list(range(side * side))


def test_text_permutation_is_one_to_one(spark):
    value = F.lpad(F.col("id").cast("string"), 4, "0")
    found = [r[0] for r in spark.range(10_000).select(pii.permuted_text(value, F.lit("ssn"), KEY)).collect()]
    assert len(set(found)) == 10_000 and found[17] == _plain_text("0017", "ssn")


def test_pseudonyms_over_the_table(spark, sf, texts):
    for r in rows(queries.op10_pseudonyms(spark, sf)):
        n = sum(v for k, v in r.items() if k.startswith("n_"))
        assert (r["text"] == texts[r["doc_id"]]) == (n == 0)
        assert len(r["text"].split("\n")) == len(texts[r["doc_id"]].split("\n"))


def test_pseudonyms_odd_and_empty(odd, empty):
    found = pii.pseudonymize(odd, KEY)
    before = {r["doc_id"]: r["text"] for r in rows(odd)}
    assert len(rows(found)) == odd.count() and {r["doc_id"]: r["text"] for r in rows(found)} == before
    assert rows(pii.pseudonymize(empty, KEY)) == []
