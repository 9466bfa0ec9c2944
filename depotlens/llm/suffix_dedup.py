"""Removal of repeated passages by column-wise suffix sorting.

A passage of ``WINDOW`` bytes that occurs twice contains the same anchor at the same offset: the least
hash of its ``GRAM``-byte substrings.  So the strings around equal anchors are laid side by side, aligned
at the anchor, and their suffixes are sorted column by column from the right: each round puts one symbol
in front of every string, updates the order of all suffixes (the transform of the collection: a stable
sort by the new symbol) and the common prefixes of neighbours (one more than the least between them).
Wherever neighbours share ``WINDOW`` symbols, both places are repeated.

Spark deals the strings by anchor, sorted, so that a task reads them in sequence and holds one bounded
batch of columns.  Anchors that are too frequent for a batch are settled by counting the checksums of
their windows instead, with the counts combined before they move; both ways give the same places.

A stretch of short period would have an anchor in each period.  There a window equals the one a period before,
which settles both, and only the windows of the first period go to the columns: a text of one repeated letter
has one anchor, however long it is.

Equal texts are collapsed first: everything in a text of ``WINDOW`` bytes or more that occurs twice is
repeated.

Defined cases: a null text counts as empty; texts shorter than the window keep all their bytes; repeated
rows are copies like any other; texts of any length are read whole; of equal hashes in a window the first
place is its anchor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.shingles import mixed
from depotlens.session import bucketed_table, written_table

#: Bytes of a repeated passage, bytes of an anchor, strings in a batch, strings of an anchor in columns.
WINDOW, GRAM = 400, 32
BATCH, HOT = 8_192, 20_000
#: Rows of an Arrow batch of strings or checksums.
ROWS = 10_000
REACH = WINDOW - GRAM
_TABLE = np.random.default_rng(1979).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position, by doubling."""
    out, length = _TABLE[raw], 1
    for factor in _FACTORS:
        out = out[:-length] * np.uint64(factor) + out[length:]
        length *= 2
    return mixed(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    length = 1
    out = values
    while 2 * length <= width:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = width - length
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, first and last window start of every anchor; each window has exactly one."""
    if len(raw) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    hashes = gram_hashes(raw)
    keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_min(keyed, REACH + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    at = least[first]
    return at, hashes[at], first, last


def periodic_starts(raw: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that periodic stretches settle: those with a copy one period earlier, and those of either copy.

    A stretch of short period has an anchor in every period.  Neighbouring anchors with equal hashes give the
    periods that occur; a window that equals the one a period before is repeated, and so is the earlier one.
    Only the first period of a stretch is left to the columns, where other texts meet it.
    """
    starts = len(raw) - WINDOW + 1
    again, either = np.zeros(max(starts, 0), bool), np.zeros(max(starts, 0), bool)
    for period in np.unique(np.diff(at)[key[1:] == key[:-1]]).tolist():
        differing = np.concatenate([[0], np.cumsum(raw[period:] != raw[:-period])])
        equal = differing[WINDOW:] == differing[:-WINDOW]
        again[period:] |= equal
        either[period:] |= equal
        either[:-period] |= equal
    return again, either


def anchors_and_runs(raw: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """:func:`anchors` of the windows that periodic stretches leave open, and the byte ranges those settle."""
    at, key, first, last = anchors(raw)
    if not (key[1:] == key[:-1]).any():
        return (at, key, first, last), []
    again, either = periodic_starts(raw, at, key)
    open_before = np.concatenate([[0], np.cumsum(~again)])
    kept = open_before[last + 1] > open_before[first]
    opened = np.flatnonzero(~again)
    low, high = open_before[first[kept]], open_before[last[kept] + 1] - 1
    return (at[kept], key[kept], opened[low], opened[high]), _intervals(either)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, rows = batch.column("digest"), []
        for i, text in enumerate(batch.column("text").to_pylist()):
            (at, key, first, last), runs = anchors_and_runs(np.frombuffer(_bytes(text), np.uint8))
            rows.append((np.full(len(at), i), np.zeros(len(at), bool), at, key.view(np.int64), first, last))
            if runs:
                begin, end = np.array(runs, np.int64).T
                rows.append((np.full(len(begin), i), np.ones(len(begin), bool), begin, begin, begin, end))
        if not rows:
            continue
        owner, settled, *places = (np.concatenate(x) for x in zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [digests.take(pa.array(owner)), pa.array(settled), *(pa.array(x.astype(np.int64)) for x in places)],
            names=["digest", "settled", "at", "key", "first", "last"],
        )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around every anchor of a text, as far as its windows reach."""
    names = ["digest", "key", "at", "first", "string"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for digest, text, places in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "places"))):
            raw = _bytes(text)
            for some in range(0, len(places), ROWS):
                rows = [
                    (digest, p["key"], p["at"], p["first"], raw[p["first"]:p["last"] + WINDOW])
                    for p in places[some:some + ROWS]
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


STRINGS = "digest binary, key long, at long, first long, string binary"


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for many ranges."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[low[here]], table[high[here] - width + 1])
    return out


def repeated_starts(strings: list[bytes], offsets: list[int]) -> np.ndarray:
    """Which window starts of aligned strings occur in two strings, by column-wise suffix sorting.

    ``offsets`` hold how far before the anchor each string begins.  Column ``REACH`` is the first byte of
    the anchor; the result has one row per string and one column per start, from ``REACH`` bytes before
    the anchor to the anchor itself.
    """
    n, columns = len(strings), REACH + WINDOW
    symbols = np.zeros((n, columns), np.uint16)  # 0: beyond the string
    for row, string, offset in zip(symbols, strings, offsets):
        begin = REACH - offset
        row[begin:begin + len(string)] = np.frombuffer(string, np.uint8)
        row[begin:begin + len(string)] += 1
    symbols = np.ascontiguousarray(symbols.T)
    repeated = np.zeros((REACH + 1, n), bool)
    order, common = np.arange(n), np.zeros(n, np.int32)  # common[i]: of order[i - 1] and order[i]
    for column in range(columns - 1, -1, -1):
        front = symbols[column][order]
        moved = np.argsort(front, kind="stable")
        front = front[moved]
        same = np.flatnonzero((front[1:] == front[:-1]) & (front[1:] > 0)) + 1
        new = np.zeros(n, np.int32)
        new[same] = 1 + _range_least(common, moved[same - 1] + 1, moved[same])
        order, common = order[moved], new
        if column <= REACH:
            found = same[new[same] >= WINDOW]
            repeated[column, order[found]] = True
            repeated[column, order[found - 1]] = True
    return np.ascontiguousarray(repeated.T)


def _intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of repeated starts as byte ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], starts, [False]]).astype(np.int8)))
    return [(int(a), int(b) - 1 + WINDOW) for a, b in zip(edges[::2], edges[1::2])]


def _in_columns(batch_size: int):
    def solve(rows: list[tuple[bytes, int, int, bytes]]) -> pa.RecordBatch | None:
        flags = repeated_starts([r[3] for r in rows], [r[1] - r[2] for r in rows])
        out = [
            (digest, at - REACH + a, at - REACH + b)
            for (digest, at, _, _), row in zip(rows, flags) if row.any() for a, b in _intervals(row)
        ]
        if not out:
            return None
        digest, begin, end = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
            names=["digest", "begin", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, int, bytes]] = []
        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "digest", "at", "first", "string")]
            for key, *row in zip(*columns):
                if key != last and len(rows) >= batch_size:
                    if (found := solve(rows)) is not None:
                        yield found
                    rows = []
                last = key
                rows.append(tuple(row))
        if rows and (found := solve(rows)) is not None:
            yield found

    return run


def _window_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksum of every window of a string."""
    names = ["digest", "begin", "sum"]
    kinds = [pa.binary(), pa.int64(), pa.binary()]
    for batch in batches:
        rows: list[tuple[bytes, int, bytes]] = []
        for digest, first, string in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "string"))):
            rows += [(digest, first + i, xxhash.xxh3_128_digest(string[i:i + WINDOW]))
                     for i in range(len(string) - WINDOW + 1)]
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), sha.alias("sha256"),
        F.substring(F.unhex(sha), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _merged(ranges: DataFrame) -> DataFrame:
    """Byte ranges of every text joined where they touch or overlap, as one ordered array each."""
    of_text = Window.partitionBy("digest").orderBy("begin", "end")
    reached = F.max("end").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("starts", (reached.isNull() | (reached < F.col("begin"))).cast("int"))
    spans = starts.withColumn("span", F.sum("starts").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("digest", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, done, sha = _bytes(text), 0, hashlib.sha256()
            for span in spans:
                sha.update(raw[done:span["begin"]])
                done = span["end"]
            sha.update(raw[done:])
            sums.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("spans"), pa.array(sums)], names=["digest", "spans", "kept_sha256"]
        )


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``digest, text`` of every distinct text that has a window; copies are combined before they move.

    Texts are moved and stored this once, dealt by digest; what later steps find out about them comes to them.
    """
    long = rows.filter(F.col("n_bytes") >= WINDOW).groupBy("digest").agg(F.first("text").alias("text"))
    return bucketed_table(long, "suffix-texts", "digest")


def repeated_ranges(texts: DataFrame, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """Repeated byte ranges of the texts of :func:`distinct_texts` that have any."""
    found = written_table(texts.mapInArrow(
        _anchored, "digest binary, settled boolean, at long, key long, first long, last long"), "suffix-anchors")
    runs, found = found.filter("settled"), found.filter("NOT settled").drop("settled")
    counts = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = found.join(counts, "key").withColumn("hot", F.col("n") > hot)
    places = written_table(
        shared.groupBy("digest").agg(F.collect_list(F.struct("at", "key", "first", "last", "hot")).alias("places")),
        "suffix-places")

    def strings(frequent: bool) -> DataFrame:
        chosen = F.filter("places", lambda p: p["hot"] == F.lit(frequent))
        some = places.select("digest", chosen.alias("places")).filter(F.size("places") > 0)
        return texts.join(some.hint("shuffle_hash"), "digest").mapInArrow(_strings, STRINGS)

    columns = strings(False)
    ranges = columns.repartition("key").sortWithinPartitions("key").mapInArrow(
        _in_columns(batch), "digest binary, begin long, end long")
    sums = strings(True).select("digest", "first", "string").mapInArrow(
        _window_sums, "digest binary, begin long, sum binary")
    twice = sums.groupBy("sum").agg(F.count("*").alias("n")).filter("n > 1").select("sum")
    counted = sums.join(twice, "sum").select("digest", "begin", (F.col("begin") + WINDOW).alias("end"))
    settled = runs.select("digest", F.col("first").alias("begin"), F.col("last").alias("end"))
    return _merged(ranges.unionByName(counted).unionByName(settled))


def remove_repeats(docs: DataFrame, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row of ``docs``.

    ``spans`` are the removed byte ranges ``begin`` to ``end`` (exclusive), in order.
    """
    rows = _identified(docs)
    slim = written_table(rows.select("doc_id", "digest", "sha256", "n_bytes"), "suffix-documents")
    copies = written_table(slim.groupBy("digest").agg(F.count("*").alias("copies")), "suffix-distinct")
    texts = distinct_texts(rows)
    spans = repeated_ranges(texts, hot, batch)
    single = copies.filter("copies = 1").select("digest")
    cut = texts.join(spans.join(single, "digest").hint("shuffle_hash"), "digest").mapInArrow(
        _kept, "digest binary, spans array<struct<begin: long, end: long>>, kept_sha256 string")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<begin:long,end:long>>")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    joined = slim.join(copies, "digest").join(cut, "digest", "left")
    joined = joined.withColumn("spans", F.when(all_gone, whole).otherwise(F.coalesce("spans", none)))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    kept = F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256"))
    return joined.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        kept.alias("kept_sha256"), "spans",
    )
