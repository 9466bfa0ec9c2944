"""A mixture of sources by a low-discrepancy schedule.

The documents of a source are shuffled and strung together, and the string of words is cut into blocks of
equal length.  Slot t of the mixture goes to the source whose share of the unit interval holds the
golden-ratio point of t, so every stretch of the schedule keeps the weights.  Slots are ranked within
their source, and rank r takes block r of the shuffled string, starting over at its end; the last slot of
a source is cut so that the source takes exactly its target.

Defined cases: documents without words are in no block and take 0; a source without words gets no slot;
null is a source of its own, ordered last; repeated rows are separate documents; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.search_keys import count_below
from depotlens.session import written_table

#: A word of a text, and words in a block.
WORD, BLOCK = r"[^\x20\x09-\x0D]+", 2048
#: The unit interval in integers, and the golden ratio of it.
UNIT, GOLDEN = 1 << 31, 1327217885
#: Documents in a bucket of a source's order, and slots in a chunk of the schedule, on average.
BUCKET, CHUNK = 20_000, 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slim_documents(docs: DataFrame, seed: int) -> DataFrame:
    """Written table of ``source, doc_id, size`` and the keys of the shuffled order, without texts."""
    text = F.col("text").cast("string")
    return written_table(
        docs.select(
            F.col("source").cast("string").alias("source"),
            F.col("doc_id").cast("long").alias("doc_id"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("text_key"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("order_key"),
        ),
        "mix-documents",
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float, floor: float = 0.0
) -> DataFrame:
    """Adds ``sid``, ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources in code-point order, null last, take the weights in turn.  Targets are level * weight, held
    between ``floor`` and ``cap`` times the source's size, with the level at which they add up to ``share``
    times all sizes: what a full source cannot take is shared by weight among the rest.
    """
    ordered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    rows = sizes.withColumn("sid", ordered).withColumn("weight", weight)
    bends = rows.select(
        F.explode(
            F.array(
                F.struct((size * floor / F.col("weight")).alias("at"), F.col("weight").alias("slope"),
                         (-size * floor).alias("fixed")),
                F.struct((size * cap / F.col("weight")).alias("at"), (-F.col("weight")).alias("slope"),
                         (size * cap).alias("fixed")),
            )
        ).alias("bend"),
        size.alias("size"),
    ).select("bend.*", "size")
    upto = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.lit(1)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("size").over(everything) / 2
    held = bends.select(
        "at",
        F.sum("slope").over(upto).alias("slope"),
        (F.sum("fixed").over(upto) + total * floor).alias("fixed"),
        (total * share).alias("wanted"),
    )
    within = held.filter(F.col("fixed") + F.col("slope") * F.col("at") <= F.col("wanted"))
    rest = F.col("wanted") - F.col("fixed") - F.col("slope") * F.col("at")
    level = within.agg(
        F.max(
            F.struct("at", F.when(F.col("slope") > 1e-9, F.col("at") + rest / F.col("slope"))
                     .otherwise(F.col("at")).alias("level"))
        )["level"]
    ).first()[0]
    target = F.least(F.greatest(F.col("weight") * F.lit(level or 0.0), size * floor), size * cap)
    return rows.withColumn("target", target)


def _quotas(targets: DataFrame, block: int) -> DataFrame:
    """Words, blocks and slots of every source, and its part of the unit interval."""
    size, words = F.col("source_size"), F.col("words")
    blocks = F.ceil(size / block)
    rest = words - size * F.col("full")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        targets.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long"))
        .withColumn("full", F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long"))
        .withColumn("blocks", blocks.cast("long"))
        .withColumn("rest", rest)
        .withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    )
    upto, whole = F.sum("slots").over(before), F.sum("slots").over(every)
    point = lambda n: F.when(whole > 0, F.floor(n.cast("decimal(24,0)") * UNIT / whole)).otherwise(0)
    return rows.withColumn("low", point(upto - F.col("slots")).cast("long")).withColumn("all_slots", whole)


def schedule(quotas: DataFrame) -> DataFrame:
    """One row per slot: ``slot, sid, rank``, as many for each source as its quota.

    Slots beyond a quota are passed over, and what the low-discrepancy points left short of it, a number
    that grows with the logarithm of the schedule, follows at the end.
    """
    spark = quotas.sparkSession
    rows = quotas.filter("slots > 0").orderBy("sid").select("sid", "low", "all_slots").collect()
    slots = int(rows[0]["all_slots"]) if rows else 0
    point = F.pmod((F.pmod(F.col("slot"), F.lit(UNIT)) + 1) * F.lit(GOLDEN), F.lit(UNIT))
    place = count_below([(r["low"],) for r in rows], point)
    sid = F.get(F.lit([r["sid"] for r in rows] or [0]), place - 1)
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk")
    ).select("slot", "chunk", sid.alias("sid"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    in_chunk = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("at", in_chunk).join(bases, ["sid", "chunk"]).select(
        "slot", "sid", (F.col("base") + F.col("at")).alias("rank")
    )
    quota = quotas.select("sid", "slots")
    kept = ranked.join(quota, "sid").filter("rank < slots").select("slot", "sid", "rank")
    reached = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = quota.join(reached, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < slots")
    tail = short.select("sid", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
    return kept.unionByName(tail.select(F.lit(slots).cast("long").alias("slot"), "sid", "rank"))


def _pieces(slim: DataFrame, quotas: DataFrame, block: int) -> DataFrame:
    """The documents of every source in shuffled order, cut at the block boundaries.

    A source may be most of the table: its documents are ordered in buckets of the hash.
    """
    rows = slim.agg(F.count("*")).first()[0]
    buckets = max(1, rows // BUCKET)
    unit = F.shiftrightunsigned("order_key", 33).cast("long")
    keyed = slim.join(
        quotas.select(F.col("source").alias("of_source"), "sid"), F.col("source").eqNullSafe(F.col("of_source"))
    ).withColumn("bucket", F.floor(unit * buckets / F.lit(1 << 31)).cast("int"))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    line = Window.partitionBy("sid", "bucket").orderBy("order_key", "doc_id", "text_key", "size")
    run = keyed.select(
        "sid", "bucket", "doc_id", "text_key", "size",
        F.row_number().over(line).alias("row"),
        F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    ).join(bases, ["sid", "bucket"])
    end = F.col("base") + F.col("upto")
    run = run.withColumn("begin", end - F.col("size")).withColumn("end", end).drop("base", "upto")
    touched = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    cut = run.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, touched)))
    return cut.withColumn("from", F.greatest("begin", F.col("block") * block)).withColumn(
        "to", F.least("end", (F.col("block") + 1) * block)
    )


def mixed_blocks(quotas: DataFrame, block: int) -> DataFrame:
    """The schedule with the block each slot takes and the end of what it takes of it."""
    known = quotas.select("sid", "source_size", "blocks", "slots", "rest")
    at = schedule(quotas).join(known, "sid").withColumn("block", F.pmod(F.col("rank"), F.col("blocks")))
    end = F.least((F.col("block") + 1) * block, F.col("source_size"))
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return at.select("slot", "sid", "block", F.when(last, F.col("rest")).otherwise(end).alias("until"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    floor: float = 0.0, block: int = BLOCK, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mixture of ``docs`` (``doc_id, text, source``): what each document gives, and the slots.

    First: ``doc_id, text_key, source, size, source_size, target, taken``, one row per document, where
    ``taken`` counts the words that the mix takes from it, repeats included.  Second: ``slot, sid, block,
    until``.  Texts are read once; the rest works on a table of sizes.
    """
    slim = slim_documents(docs, seed)
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = written_table(_quotas(source_targets(sizes, weights, share, cap, floor), block), "mix-sources")
    slots = written_table(mixed_blocks(quotas, block), "mix-slots")
    pieces = _pieces(slim, quotas, block)
    given = F.greatest(F.lit(0), F.least("to", "until") - F.col("from"))
    joined = pieces.join(slots.drop("slot"), ["sid", "block"], "left").withColumn("given", F.coalesce(given, F.lit(0)))
    taken = joined.groupBy("sid", "bucket", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("size").alias("size"),
        F.sum(F.when(F.col("until").isNull(), 0).otherwise(F.col("given"))).alias("taken"),
    )
    named = taken.join(quotas.select("sid", "source", "source_size", "target"), "sid")
    return named.select("doc_id", "text_key", "source", "size", "source_size", "target", "taken"), slots


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixture as rows of ``docs``: every document as often as it is taken whole.

    The document at which a source's last round ends gives its first words, joined by spaces; a column
    ``n_chars`` then follows.
    """
    names = docs.columns
    key = ["mix_doc", "mix_key", "mix_source", "mix_row"]
    rows = docs.select(
        F.struct(*names).alias("record"),
        F.col("doc_id").cast("long").alias("mix_doc"),
        F.xxhash64(F.col("text").cast("string")).alias("mix_key"),
        F.col("source").cast("string").alias("mix_source"),
    )
    gives = taken.filter("taken > 0").select(
        F.col("doc_id").alias("mix_doc"), F.col("text_key").alias("mix_key"), F.col("source").alias("mix_source"),
        "size", "taken",
    )
    same = Window.partitionBy("mix_doc", "mix_key", "mix_source").orderBy(F.lit(1))
    rows = rows.withColumn("mix_row", F.row_number().over(same)).alias("a")
    gives = gives.withColumn("mix_row", F.row_number().over(same)).alias("b")
    met = rows.join(gives, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.pmod(F.col("taken"), F.col("size"))
    lengths = F.array_repeat(F.lit(0).cast("long"), whole)
    met = met.select(
        "record.*",
        F.explode(F.when(part > 0, F.concat(lengths, F.array(part))).otherwise(lengths)).alias("mix_words"),
    )
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("mix_words").cast("int"))
    text = F.when(F.col("mix_words") > 0, F.array_join(words, " ")).otherwise(F.col("text"))
    out = met.withColumn("text", text)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        length = F.when(F.col("mix_words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.select(*names)
