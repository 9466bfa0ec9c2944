"""A quality score learned from trusted positives and unlabelled text.

Only documents labelled good count as labelled; every document of the corpus, labelled or not, is
unlabelled text.  With the share of good documents estimated, the risk of a linear logistic score g is

    prior * E_good[l(g)]  +  max(0, E_all[l(-g)] - prior * E_good[l(-g)])

whose second term estimates the risk on bad documents without one bad label; it is never let below zero,
where it would only reward overfitting.  Damped Newton steps minimise it over all documents: each step is
one Spark job that sums risk, gradient and curvature, a fixed number of values whatever the input.

Defined cases: null and empty texts have all measures 0 and get a score from them; labels that are null
or belong to no document are ignored; a document labelled twice is good if any label says so; without
any good document every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm import kept
from depotlens.session import written_table

MEASURES = [
    "log_bytes", "log_words", "letters", "other_bytes", "capitals", "digits", "spaces", "symbols", "bars",
    "exclaims", "stops", "lines_per_word", "word_length", "distinct_words", "top_word", "same_as_last",
    "distinct_lines", "top_line", "marked_words", "ended_words",
]
RIDGE, STEPS, HALVINGS, FAR = 1e-4, 12, 8, 6.0
_BYTES = np.zeros((8, 256))
for _row, _chars in enumerate(
    (bytes(range(97, 123)) + bytes(range(65, 91)), bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789",
     b" \t\n\r\x0b\x0c", b"#*$%&|<>@^~=_{}[]\\", b"|", b"!")
):
    _BYTES[_row, list(_chars)] = 1


def measures(text: str) -> np.ndarray:
    """What the score sees of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return np.zeros(len(MEASURES))
    n_bytes, n = len(raw), len(words)
    parts = _BYTES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n_bytes
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    tails = Counter(word[-1] for word in words)
    ended = sum(tails[c] for c in ".,;:?")
    marked = sum(k for c, k in tails.items() if not c.isalnum()) - ended
    line_counts = Counter(lines)
    return np.array([
        np.log1p(n_bytes), np.log1p(n), parts[0], parts[1], parts[2], parts[3], parts[4], parts[5], parts[6],
        parts[7], raw.count(b".") / n, len(lines) / n, np.log((n_bytes - raw.count(b" ")) / n),
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n,
        len(line_counts) / len(lines), max(line_counts.values()) / len(lines), marked / n, ended / n,
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept.only(None)
    for batch in kept.pieces(batches):
        rows = [measures(t or "").astype(np.float32) for t in batch.column("text").to_pylist()]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
        offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"]
        )


def measured_documents(docs: DataFrame) -> DataFrame:
    """Written table ``doc_id, x``: the measures of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written_table(rows.mapInArrow(_measured, "doc_id long, x array<float>"), "quality-measures")


@dataclass(frozen=True)
class QualityModel:
    """Weights over scaled measures, their squares and a constant."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -FAR, FAR)
        return np.hstack([np.ones((len(z), 1)), z, z * z / FAR])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, len(MEASURES))


def _summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], length: int) -> np.ndarray:
    """Sum over all rows of a vector of ``length`` values; one vector a task is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], names=["k", "v"])

    sums = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(length)
    for row in sums:
        out[row["k"]] = row["v"]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _risk_terms(model: QualityModel) -> tuple[Callable[[pa.RecordBatch], np.ndarray], int]:
    """Per row: counts, the three risks, gradient sums and curvature of the convex part."""
    d = len(model.weights)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x = model.inputs(_matrix(batch))
        good = np.asarray(batch.column("good")).astype(bool)
        g = np.clip(x @ model.weights, -30, 30)
        p = 1 / (1 + np.exp(-g))
        everyone, xu, xp = ~good, x[~good], x[good]
        weight = (p * (1 - p))[everyone]
        return np.concatenate([
            [everyone.sum(), good.sum(), _softplus(-g[good]).sum(), _softplus(g[everyone]).sum(),
             _softplus(g[good]).sum()],
            xp.sum(axis=0), (xu * p[everyone, None]).sum(axis=0), ((xu * weight[:, None]).T @ xu).ravel(),
        ])

    return of, 5 + 2 * d + d * d


def fit(measured: DataFrame, good: DataFrame, prior: float) -> QualityModel:
    """Minimises the non-negative risk; ``good`` holds the ``x`` of the trusted positives."""
    n = len(MEASURES)
    moments = _summed(measured, lambda b: np.concatenate(
        [[b.num_rows], (x := _matrix(b)).sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * n)
    count = max(moments[0], 1)
    centre = moments[1:1 + n] / count
    scale = np.sqrt(np.maximum(moments[1 + n:] / count - centre**2, 0))
    scale[scale < 1e-6] = 1
    prior = min(max(prior, 0.01), 0.99)
    model = QualityModel(centre, scale, np.zeros(1 + 2 * n), prior)
    rows = measured.select("x", F.lit(False).alias("good")).unionByName(good.select("x", F.lit(True).alias("good")))
    d = len(model.weights)
    ridge = np.full(d, RIDGE + 1 / max(good.count(), 1))
    ridge[0] = 0  # the level of the score follows the prior, however few positives hold the slopes down

    def at(weights: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        of, length = _risk_terms(QualityModel(centre, scale, weights, prior))
        s = _summed(rows, of, length)
        everyone, trusted = max(s[0], 1), max(s[1], 1)
        bad = s[3] / everyone - prior * s[4] / trusted
        risk = prior * s[2] / trusted + max(bad, 0) + ridge @ weights**2 / 2
        slope = s[5 + d:5 + 2 * d] / everyone - prior * s[5:5 + d] / trusted + ridge * weights
        curve = s[5 + 2 * d:].reshape(d, d) / everyone + np.diag(ridge) + 1e-9 * np.eye(d)
        return risk, bad, slope, curve

    weights, (risk, _, slope, curve) = model.weights, at(model.weights)
    for _ in range(STEPS):
        step, size = np.linalg.solve(curve, -slope), 1.0
        for _ in range(HALVINGS):
            new = at(weights + size * step)
            if new[0] < risk and new[1] >= 0:
                break
            size /= 2
        else:
            break
        done = risk - new[0] < 1e-5
        weights, (risk, _, slope, curve) = weights + size * step, new
        if done:
            break
    return QualityModel(centre, scale, weights, prior)


def scored(measured: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every measured document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return measured.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more; all columns as they were, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.only(None)
        for batch in kept.pieces(batches):
            texts = batch.column("text").cast(pa.string()).to_pylist()
            if texts:
                good = model.scores(np.stack([measures(t or "").astype(np.float32) for t in texts])) >= least
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def in_fold(doc_id: Column) -> Column:
    """Third of the documents, by the checksum of the id, whose labels are not learned."""
    checksum = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(checksum, F.lit(3)) == 1


def learn(measured: DataFrame, labels: DataFrame) -> QualityModel | None:
    """Model from ``labels`` (``doc_id, quality``); None without a good document.

    The labels give the trusted positives and the estimate of the prior, the share of good labels.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max("quality").cast("double").alias("quality"))
    good = written_table(measured.join(known.filter("quality = 1"), "doc_id").select("x"), "quality-good")
    share = known.agg(F.avg("quality")).first()[0]
    if not share or good.isEmpty():
        return None
    return fit(measured, good, share)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``).

    Labels of held-out documents are never read into the model.
    """
    measured = measured_documents(docs)
    model = learn(measured, labels.filter(~in_fold(F.col("doc_id"))))
    scores = scored(measured, model) if model else measured.select("doc_id", F.lit(0.5).alias("score"))
    return scores.select(
        "doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
