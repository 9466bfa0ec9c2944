"""Quality rules as a short-circuit cascade.

Each rule needs a few measures of the text.  On a sample every rule is timed and its rejections are
counted; rules then run in the order of rejections per second, and a document that a rule rejected is not
measured any further.  The order decides only what is spent: a document is kept if all rules keep it.

Everything is a column expression inside the row; no text is exploded or shuffled.

Defined cases: a null text counts as empty; a document without words fails the word rule; repeated rows
are judged separately; an empty table gives no rows.  Columns of the input keep their names; measures
come back in one column, ``measures``, and replace a column of that name, as does ``kept``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.session import written_table

WORD, WINDOW = r"[^\x20\x09-\x0D]+", 8
SAMPLE_ROWS, SAMPLE_SEED = 2_000, 29
Step = tuple[str, Callable[[], Column]]


def _col(name: str) -> Column:
    return F.col("_" + name)


def _long(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("long")


def _pairwise(source: str, distance: int) -> Callable[[], Column]:
    """Hash of every element with the one ``distance`` further on."""
    return lambda: F.transform(_col(source), lambda x, i: F.xxhash64(x, F.get(_col(source), i + distance)))


def _places() -> Column:
    """Starts of the windows that occur twice or more, ascending; null where there are none."""
    repeated = F.size(F.array_distinct(_col("windows"))) < F.size(_col("windows"))
    pairs = F.transform(_col("windows"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(repeated, F.sort_array(pairs))


def _twice() -> Column:
    pairs = _col("sorted_windows")
    same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
    found = F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered() -> Column:
    places = _col("places")
    width = F.transform(
        places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(width, F.lit(0), lambda a, x: a + x)


#: Steps that lead to each measure, over the column ``_text``; steps that measures share run once.
WORDS: list[Step] = [("words", lambda: F.regexp_extract_all(_col("text"), F.lit(WORD), F.lit(0)))]
LINES: list[Step] = [
    ("lines", lambda: F.filter(F.split(_col("text"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
]
MEASURES: dict[str, list[Step]] = {
    "n_words": [*WORDS, ("n_words", lambda: _long(F.size(_col("words"))))],
    "word_chars": [*WORDS, ("word_chars", lambda: _long(F.length(F.array_join(_col("words"), ""))))],
    "n_symbols": [("n_symbols", lambda: _long(F.regexp_count(_col("text"), F.lit("[#*$%&|<>]"))))],
    "n_exclaims": [("n_exclaims", lambda: _long(F.regexp_count(_col("text"), F.lit("!"))))],
    "n_lines": [*LINES, ("n_lines", lambda: _long(F.size(_col("lines"))))],
    "n_dup_lines": [
        *LINES,
        ("n_dup_lines", lambda: _long(F.size(_col("lines")) - F.size(F.array_distinct(_col("lines"))))),
    ],
    "n_repeat_words": [
        *WORDS,
        ("word_keys", lambda: F.transform(_col("words"), lambda w: F.xxhash64(w))),
        ("pair_keys", _pairwise("word_keys", 1)),
        ("four_keys", _pairwise("pair_keys", 2)),
        ("windows", lambda: F.when(
            F.size(_col("words")) >= WINDOW,
            F.slice(_pairwise("four_keys", 4)(), F.lit(1), F.size(_col("four_keys")) - F.lit(WINDOW - 1)))),
        ("sorted_windows", _places),
        ("places", _twice),
        ("n_repeat_words", lambda: _long(_covered())),
    ],
}


@dataclass(frozen=True)
class Rule:
    """Keeps a document if ``keeps`` holds for its measures."""

    name: str
    needs: tuple[str, ...]
    keeps: Callable[[dict[str, Column]], Column]


#: Short texts and texts that repeat themselves, then signs of machine noise.
BASE_RULES = [
    Rule("enough_words", ("n_words",), lambda m: m["n_words"] >= 20),
    Rule("few_repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] <= 30 * m["n_words"]),
]
NOISE_RULES = [
    Rule("few_symbols", ("word_chars", "n_symbols"), lambda m: 100 * m["n_symbols"] <= 5 * m["word_chars"]),
    Rule("few_exclaims", ("n_words", "n_exclaims"), lambda m: 100 * m["n_exclaims"] <= 30 * m["n_words"]),
    Rule("few_dup_lines", ("n_lines", "n_dup_lines"),
         lambda m: (m["n_dup_lines"] <= 3) | (100 * m["n_dup_lines"] <= 30 * m["n_lines"])),
    Rule("word_length", ("n_words", "word_chars"),
         lambda m: (m["word_chars"] >= 2 * m["n_words"]) & (m["word_chars"] <= 20 * m["n_words"])),
]
RULES = [*BASE_RULES, *NOISE_RULES]


def _measure(rows: DataFrame, names: tuple[str, ...], wanted: Column) -> DataFrame:
    """Adds the steps of some measures; where ``wanted`` is false their text is null and costs nothing."""
    for name in names:
        for step, build in MEASURES[name]:
            if "_" + step in rows.columns:
                continue
            value = build()
            rows = rows.withColumn("_" + step, F.when(wanted, value))
    return rows


def _column_of(names: tuple[str, ...]) -> dict[str, Column]:
    return {name: _col(name) for name in names}


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("record"), text.alias("_text"))


def rule_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per second on a sample, with the cost and the share each rejects."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = written_table(_text_rows(docs).select("_text").sample(share, SAMPLE_SEED), "quality-sample")

    def timed(names: tuple[str, ...], value: Column) -> tuple[float, float]:
        took, found = [], 0.0
        for _ in range(2):
            start = time.perf_counter()
            found = _measure(sample, names, F.lit(True)).agg(F.avg(value)).first()[0] or 0.0
            took.append(time.perf_counter() - start)
        return min(took), found

    idle, _ = timed((), F.length("_text"))
    judged = []
    for rule in rules:
        cost, kept = timed(rule.needs, rule.keeps(_column_of(rule.needs)).cast("double"))
        judged.append((rule, max(cost - idle, 1e-3), 1 - kept))
    return sorted(judged, key=lambda r: (-r[2] / r[1], r[0].name))


def quality_cascade(
    docs: DataFrame, rules: list[Rule] | None = None, report: bool = False, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``docs`` with ``kept``, and ``measures`` as far as each document was measured.

    With ``report`` the measures are completed for rejected documents as well.
    """
    rules = RULES if rules is None else rules
    rows = _text_rows(docs).withColumn("_kept", F.lit(True))
    for rule, _, _ in rule_order(docs, rules, sample_rows):
        rows = _measure(rows, rule.needs, F.lit(True) if report else F.col("_kept"))
        keeps = F.coalesce(rule.keeps(_column_of(rule.needs)), F.lit(False))
        rows = rows.withColumn("_kept", F.col("_kept") & keeps)
    names = sorted({name for rule in rules for name in rule.needs})
    kept = [f"record.{c}" for c in docs.columns if c not in ("kept", "measures")]
    return rows.select(
        *kept, F.struct(*[_col(n).alias(n) for n in names]).alias("measures"), F.col("_kept").alias("kept")
    )
