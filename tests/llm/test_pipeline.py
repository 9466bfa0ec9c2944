"""The pipeline: every stage on its predecessor's rows."""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from depotlens.llm import quality_classifier
from depotlens.session import written_table


def test_stages_follow_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    source = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    scores = quality_classifier.quality_scores(
        spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert {i for i, _ in kept["quality"]} == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    texts = dict(kept["quality"])
    classes = brute.classes(texts)
    assert {i for i, _ in kept["near_duplicates"]} == set(classes.values())
    texts = dict(kept["near_duplicates"])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    dirty = {i for i, _ in brute.leaks(texts, items)}
    assert dirty and {i for i, _ in kept["decontaminate"]} == set(texts) - dirty
    copies = Counter(i for i, _ in kept["mix"])
    assert set(copies) == {i for i, _ in kept["decontaminate"]} and max(copies.values()) == 2
    assert all(t == source[i] or source[i].split()[:len(t.split())] == t.split() for i, t in kept["mix"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert Counter(r["doc_id"] for r in out.collect()) == copies


def test_run_equals_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) == len({r["start"] for r in out}) and min(r["start"] for r in out) == 0
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_stages_on_odd_and_empty_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_first_stage_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.quality(spark, docs, sf).join(labels, "doc_id")
    good = labels.join(docs, "doc_id").filter("quality = 1").count()
    assert left.filter("quality = 1").count() >= 0.9 * good
    assert left.filter("quality = 0").count() <= 0.2 * labels.filter("quality = 0").count()
    assert left.filter(F.col("text").isNull()).count() == 0
