"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns.  Its identity is the XOR of 128-bit hashes of (position, role,
text), so prefixes of one conversation are running XORs: turns are range-partitioned by conversation and
turn, summed up inside chunks and carried from chunk to chunk.  No conversation is gathered in one task.

Subtree totals come from tree contraction.  Every round rakes the leaves, whose totals are complete, into their
parents, and compresses unary chains: of the nodes with one child left those with the least hash among parent,
node and child are spliced out, so no two neighbours go at once.  A spliced node leaves its amount on the
edge from its child to its own parent, and a record of what it misses.  Rounds grow with the logarithm of the
number of nodes, also for one chain.  At the end the records are expanded again: a spliced node's total is its
own amount plus that of the child it went with, found by joins that double the distance.

Rows of the same turn number are ordered by the beginnings of role and text, then by hashes of both.

Defined cases: a null role or text counts as empty; a null turn comes first; rows without ``conv_id`` are in no
conversation; c % 20 has the sign of c, as in SQL; equal rows are separate turns; texts of any length count whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.hot_keys import lookup
from depotlens.operators.skew import ordered_positions
from depotlens.session import new_folder, written_table, written_to

#: Conversations that share a first one, and remainders of the checksum that say how many turns they take.
FAMILY, HEADS = 20, 4
#: Characters of role and text that order turns of one number before their hashes do.
_ROLE, _TEXT = 16, 64
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, ka, kb, words``: every turn with a 128-bit hash of role and text, in its place."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return rows.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.substring("role", 1, _ROLE).alias("role_at"), F.substring("text", 1, _TEXT).alias("text_at"),
        F.xxhash64("role", "text").alias("ka"), F.xxhash64(F.lit(1), "text", "role").alias("kb"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _hashed(depth: Column, ka: Column, kb: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, ka, kb), F.xxhash64(F.lit(7), kb, depth, ka)


def _node(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _head_prefixes(head: Column) -> Column:
    """Running XORs over at most ``HEADS - 1`` turns, the empty prefix first."""
    a = b = F.lit(0).cast("long")
    found = [F.struct(F.lit(0).alias("depth"), a.alias("a"), b.alias("b"), F.lit(0).cast("long").alias("words"))]
    for i in range(HEADS - 1):
        turn = F.get(head, F.lit(i))
        ta, tb = _hashed(F.lit(i + 1).cast("long"), turn["ka"], turn["kb"])
        a, b = a.bitwiseXOR(ta), b.bitwiseXOR(tb)
        found.append(F.struct(F.lit(i + 1).alias("depth"), a.alias("a"), b.alias("b"), turn["words"].alias("words")))
    return F.slice(F.array(*found), 1, F.size(head) + 1)


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, words, last``: every prefix of every rebuilt conversation.

    Conversation c is made of the first turns, one for each in crc32(c) % 4, of conversation c - c % 20 and of
    its own turns after as many.  ``last`` marks the whole conversation.
    """
    placed = ordered_positions(turn_rows(conversations), ["conv_id", "turn", "role_at", "text_at", "ka", "kb"])
    parts = placed.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    parts = written_table(parts, "trie-parts")  # one row for each conversation of each chunk
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    rank = F.col("before") + F.col("position") - F.col("first") + 1
    bases = parts.filter((F.col("conv_id") % FAMILY == 0) & (F.col("before") < HEADS - 1))
    heads = placed.join(bases, ["conv_id", "chunk"]).select("conv_id", rank.alias("rank"), "ka", "kb", "words").filter(
        F.col("rank") < HEADS)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "ka", "kb", "words"))).alias("head"))  # three turns at most
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("own")).select(
        "conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(
        F.coalesce("head", F.expr("CAST(array() AS array<struct<rank:bigint,ka:bigint,kb:bigint,words:bigint>>)")), F.lit(1), F.col("h")))
    convs = convs.select("conv_id", "h", F.size("head").alias("m"), _head_prefixes(F.col("head")).alias("prefixes"),
                         (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    convs = written_table(convs, "trie-conversations")
    known = convs.select("conv_id", "turns", F.posexplode("prefixes").alias("i", "p"), "prefixes")
    before = F.when(F.col("i") > 0, F.get("prefixes", F.col("i") - 1))
    opened = known.select(
        "conv_id", F.col("i").cast("long").alias("depth"), _node(F.col("p.a"), F.col("p.b")).alias("node"),
        F.when(F.col("i") > 0, _node(before["a"], before["b"])).alias("parent"), F.col("p.words").alias("words"),
        (F.col("i") == F.col("turns")).alias("last"))
    whole = F.element_at("prefixes", -1)
    begun = parts.join(convs.select("conv_id", "h", "m", "turns", whole["a"].alias("ha"), whole["b"].alias("hb")), "conv_id")
    own = placed.select("conv_id", "chunk", "position", "ka", "kb", "words").join(begun, ["conv_id", "chunk"])
    own = own.withColumn("rank", rank).filter("rank > h").withColumn("depth", (F.col("m") + F.col("rank") - F.col("h")).cast("long"))
    ta, tb = _hashed(F.col("depth"), F.col("ka"), F.col("kb"))
    own = own.select("conv_id", "chunk", "position", "depth", ta.alias("ta"), tb.alias("tb"), "ha", "hb", "words", "turns")
    sums = own.groupBy("conv_id", "chunk").agg(F.bit_xor("ta").alias("sa"), F.bit_xor("tb").alias("sb"))
    zero = F.lit(0).cast("long")
    sums = sums.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), zero).alias(n) for c, n in (("sa", "ca"), ("sb", "cb"))])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("ia", F.bit_xor("ta").over(inside)).withColumn("ib", F.bit_xor("tb").over(inside)).join(
        sums, ["conv_id", "chunk"])
    a = F.col("ia").bitwiseXOR(F.col("ca")).bitwiseXOR(F.col("ha"))
    b = F.col("ib").bitwiseXOR(F.col("cb")).bitwiseXOR(F.col("hb"))
    followed = run.select("conv_id", "depth", _node(a, b).alias("node"),
                          _node(a.bitwiseXOR(F.col("ta")), b.bitwiseXOR(F.col("tb"))).alias("parent"), "words",
                          (F.col("depth") == F.col("turns")).alias("last"))
    return opened.unionByName(followed)


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """``node`` and, for every name in ``values``, the sum over the node's subtree, itself included.

    ``tree``: ``node, parent`` (null for a root) and the values as long; every parent is a node.
    """
    edges = [f"edge_{v}" for v in values]
    state = tree.select(
        "node", "parent", *[F.col(v).cast("long").alias(v) for v in values],
        *[F.lit(0).cast("long").alias(e) for e in edges])
    kids = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    state = state.join(kids, "node", "left").withColumn("leaf", F.col("kids").isNull()).drop("kids")
    folder, number = new_folder(tree.sparkSession, "trie-rounds"), 0
    while True:
        number += 1
        leaf = F.col("leaf")
        given = state.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(leaf, F.col(v) + F.col(e)).otherwise(0)).alias(f"from_{v}") for v, e in zip(values, edges)],
            F.count_if(~leaf).alias("left"), F.max(F.when(~leaf, F.struct("node", *edges))).alias("child"))
        state = state.join(given, "node", "left").select(
            "node", "parent", *[(F.col(v) + F.coalesce(f"from_{v}", F.lit(0))).alias(v) for v in values], *edges,
            "leaf", F.coalesce("left", F.lit(0)).alias("left"), F.when(F.col("left") == 1, F.col("child")).alias("child"))
        least = [F.xxhash64(F.lit(number), c) for c in ("node", "parent", "child.node")]
        going = F.col("child").isNotNull() & F.col("parent").isNotNull() & (least[0] < least[1]) & (least[0] < least[2])
        state = written_to(state.withColumn("going", going), f"{folder}/round={number}")
        stays = state.filter("NOT leaf")
        if stays.isEmpty():
            break
        moved = stays.filter("going").select(F.col("child.node").alias("node"), F.col("parent").alias("above"), *[
            (F.col(v) + F.col(e)).alias(f"more_{v}") for v, e in zip(values, edges)])
        state = stays.filter("NOT going").join(moved, "node", "left").select(
            "node", F.coalesce("above", "parent").alias("parent"), *values,
            *[(F.col(e) + F.coalesce(f"more_{v}", F.lit(0))).alias(e) for v, e in zip(values, edges)],
            (F.col("left") == 0).alias("leaf"))
    # every node left in one round, raked or spliced; all rounds are one scan, however many there were
    rounds = tree.sparkSession.read.schema(state.schema).parquet(folder)
    total = rounds.filter("leaf").select("node", *values)
    records = rounds.filter("going").select("node", F.col("child.node").alias("next"), *[
        (F.col(v) + F.col(f"child.{e}")).alias(v) for v, e in zip(values, edges)])
    records = written_table(records, "trie-spliced")
    for _ in range(ceil(log2(number + 1))):  # a record points to a later round, so chains are shorter than the rounds
        ahead = records.select(F.col("node").alias("next"), F.col("next").alias("far"), *[F.col(v).alias(f"far_{v}") for v in values])
        records = lookup(records, ahead, ["next"]).select(
            "node", F.coalesce("far", "next").alias("next"), *[(F.col(v) + F.coalesce(f"far_{v}", F.lit(0))).alias(v) for v in values])
        records = written_table(records, "trie-spliced")
    known = total.select(F.col("node").alias("next"), *[F.col(v).alias(f"far_{v}") for v in values])
    expanded = lookup(records, known, ["next"]).select("node", *[(F.col(v) + F.col(f"far_{v}")).alias(v) for v in values])
    return total.unionByName(expanded)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as one comma-joined text a node and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column("node").field(i).to_numpy() for i in (0, 1))
        ids = batch.column("conv_id").to_pylist()
        starts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1])
        texts = [",".join(map(str, ids[x:y])) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(starts)), pa.array([ids[s] for s in starts.tolist()], pa.int64()), pa.array(texts)],
            names=["node", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node from its sorted texts, fed as they stream by."""
    last, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"node": last, "ends_sha256": state.hexdigest()}],
            schema=pa.schema([("node", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("ends_sha256", pa.string())]))

    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != last:
                if state is not None:
                    yield closed()
                last, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield closed()


def ends_digests(members: DataFrame) -> DataFrame:
    """``node, ends_sha256`` over the ids of the conversations that end at a node, ascending.

    A digest is read from first to last byte, so the last step of a node is one task; before it the ids are
    sorted by range and joined to one text a batch, and that task holds one text at a time.
    """
    ends = members.filter("last").select("node", "conv_id")
    listed = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        _listed, "node struct<a:bigint,b:bigint>, first long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _digested, "node struct<a:bigint,b:bigint>, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node``."""
    members = written_table(rebuilt_prefixes(conversations), "trie-members")
    nodes = members.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = written_table(nodes, "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    named = nodes.join(ends_digests(members), "node", "left")
    named = written_table(named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "trie-named")
    totals = subtree_totals(named.select(
        "node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    above = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(named, above, ["parent"]).join(totals, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node")
