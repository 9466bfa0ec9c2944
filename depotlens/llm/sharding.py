"""Shards of near-equal bytes by sampled splitters.

Records are keyed by the hash of their text, so copies lie side by side, then by the hash of their
``doc_id``.  Keys are sampled in proportion to record size, the quantiles of the sample become the
boundaries of many small ranges, and records are partitioned by range.  A key that fills more than one
quantile is cut inside; a range that turns out overfull is divided further.  Byte offsets of the ranges
and running sums inside them place every record on one line of bytes, which is cut into equal shards.

Defined cases: a null text has size 8; copies of one text share a shard unless together they are larger
than the largest record, then they may be cut; repeated rows keep separate slots; an empty table gives
no rows.  Columns of the input named like an output column are replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.search_keys import count_below
from depotlens.session import written_table

#: Ranges for each shard, and sampled keys expected for each range.
RANGES, SAMPLES = 64, 16
LEAST = -(1 << 63)
ADDED = ["size", "shard", "slot"]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none if null, plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("record"),
        record_size(text).alias("size"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64(F.lit("tie"), F.col("doc_id").cast("string")).alias("tie_key"),
    )


def sampled_splitters(keys: DataFrame, total: int, ranges: int, samples: int) -> list[tuple[int, int]]:
    """Boundaries between ``ranges`` ranges of about equal bytes, from a sample of bounded size.

    A record is drawn with the expected multiplicity size * rate; the draw depends on its key alone, so
    a repeated task draws the same records.
    """
    rate = ranges * samples / max(total, 1)
    chance = F.pmod(F.xxhash64(F.lit("draw"), "text_key", "tie_key"), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = keys.withColumn("times", F.floor(F.col("size") * F.lit(rate) + chance).cast("int")).filter("times > 0")
    line = drawn.select(F.explode(F.array_repeat(F.struct("text_key", "tie_key"), F.col("times"))).alias("key"))
    ordered = line.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    quantile = lambda i: F.get(F.col("keys"), (i * F.size("keys") / F.lit(ranges)).cast("int"))
    row = ordered.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), quantile).alias("cuts")).first()
    cuts = sorted({(c["text_key"], c["tie_key"]) for c in row["cuts"] if c is not None})
    hot = {a[0] for a, b in zip(cuts, cuts[1:]) if a[0] == b[0]}
    return sorted({(key, tie if key in hot else LEAST) for key, tie in cuts})


def _subdivided(keys: DataFrame, ranges: DataFrame, cuts: list[tuple[int, int]], target: float) -> Column:
    """Number of the part within its range: 0 unless the range is overfull."""
    overfull = ranges.filter(F.col("bytes") > 2 * target).collect()
    if not overfull:
        return F.lit(0)
    inside_one_key = [cuts[r["range"] - 1][0] == cuts[r["range"]][0] if 0 < r["range"] < len(cuts) else False
                      for r in overfull]
    parts = [-(-r["bytes"] // max(int(target), 1)) for r in overfull]
    choices = [
        (r["range"], F.pmod(F.xxhash64(F.lit("part"), "tie_key" if one else "text_key"), F.lit(n)).cast("int"))
        for r, n, one in zip(overfull, parts, inside_one_key)
    ]
    return reduce(lambda rest, c: F.when(F.col("range") == c[0], c[1]).otherwise(rest), choices, F.lit(0))


def shard_documents(
    docs: DataFrame, n_shards: int, carry: list[str] | None = None, ranges_per_shard: int = RANGES,
    samples_per_range: int = SAMPLES,
) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    ``carry`` names the columns to keep, all by default.  Shards differ from the mean by at most the largest record.  Two passes over the texts; everything
    between them reads a table of keys and sizes.
    """
    keyed = _keyed(docs, [c for c in (docs.columns if carry is None else carry) if c not in ADDED])
    keys = written_table(keyed.select("text_key", "tie_key", "size"), "shard-keys")
    whole = keys.agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).first()
    total, largest, ranges = whole["bytes"] or 1, whole["largest"] or 0, n_shards * ranges_per_shard
    cuts = sampled_splitters(keys, total, ranges, samples_per_range)
    in_range = count_below(cuts, F.col("text_key"), F.col("tie_key")).cast("int")
    measured = keys.withColumn("range", in_range).groupBy("range").agg(F.sum("size").alias("bytes"))
    part = _subdivided(keys, measured, cuts, total / ranges)

    def ranged(rows: DataFrame) -> DataFrame:
        return rows.withColumn("range", in_range).withColumn("part", part)

    pieces = ranged(keys).groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    line = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    bases = pieces.select(
        "range", "part", F.sum("bytes").over(line).alias("bytes"), F.sum("n").over(line).alias("n")
    ).orderBy("range", "part").collect()
    piece_at = count_below([(r["range"], r["part"]) for r in bases], F.col("range"), F.col("part")) - 1
    byte_base = F.get(F.lit([r["bytes"] or 0 for r in bases] or [0]), piece_at)
    row_base = F.get(F.lit([r["n"] or 0 for r in bases] or [0]), piece_at)

    def placed(rows: DataFrame) -> DataFrame:
        piece = Window.partitionBy("range", "part")
        line = piece.orderBy("text_key", "tie_key", "size")
        copies = Window.partitionBy("range", "part", "text_key")
        run = ranged(rows).select(
            "*",
            (F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_at"),
            (F.row_number().over(line) - 1).alias("row_at"),
        )
        run = run.withColumn("copies", F.sum("size").over(copies)).withColumn("copies_at", F.min("byte_at").over(copies))
        run = run.withColumn("byte_base", byte_base).withColumn("row_base", row_base)
        together = F.col("copies") <= F.lit(largest)
        at = F.col("byte_base") + F.when(together, F.col("copies_at")).otherwise(F.col("byte_at"))
        length = F.when(together, F.col("copies")).otherwise(F.col("size"))
        middle = (F.lit(2) * at + length).cast("decimal(24,0)")
        shard = F.floor(middle * F.lit(n_shards) / F.lit(2 * total).cast("decimal(24,0)"))
        return run.withColumn("shard", shard.cast("int")).withColumn("line", F.col("row_base") + F.col("row_at"))

    first = placed(keys).groupBy("shard").agg(F.min("line").alias("line")).collect()  # a row for each shard
    starts = [0] * n_shards
    for row in first:
        starts[row["shard"]] = row["line"]
    slot = F.col("line") - F.get(F.lit(starts), F.col("shard"))
    return placed(keyed).select("record.*", "size", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int) -> str:
    """Writes the sharded documents under ``path``, one folder a shard; several tasks share a shard."""
    shard_documents(docs, n_shards).write.partitionBy("shard").parquet(path)
    return path
