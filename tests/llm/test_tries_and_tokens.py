"""Operators 11 to 13 against plain versions, and their awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from depotlens.llm import conversation_trie, hot_keys, queries, simhash_dedup, token_alignment, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# 11. conversation prefix trie

def plain_trie(turns):
    """Nodes by (conv_id, depth): every subtree walked from its node."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(int(c / 20) * 20, [])[:h] + mine[h:])  # c - c % 20 as in SQL
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in children[key]) if children[key] else 1
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in children[key])
    return Counter(
        (m[0], len(key), members[key[:-1]][0] if key else None, len(m), len(children[key]), leaves[key], saved[key],
         hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(key)).encode()).hexdigest())
        for key, m in members.items())


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r[n] for n in names) for r in rows(df))


def test_trie_of_the_given_table(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op11_conversation_trie(spark, sf)) == plain_trie(turns)


def test_trie_of_hot_long_and_odd_conversations(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice("ua"), rng.choice(["a", "b b", ""])) for c in range(150) for t in range(rng.randrange(1, 7))]
    turns += [(c, t, "u", f"copy {t} of") for c in range(200, 320) for t in range(5)]  # many equal conversations
    turns += [(400, t, "u", f"long {t}") for t in range(700)]  # a chain that only compression shortens
    turns += [(401, t, "u", f"long {t}" if t != 650 else "branch") for t in range(690)]
    turns += [(-5, 1, None, None), (-5, None, "u", "first"), (-20, 1, "u", "x"), (None, 1, "u", "nobody"), (500, 7, "u", "w " * 30_000)]
    turns += [(501, t, "u", "late") for t in (2, 2, 2)]
    rng.shuffle(turns)
    table = spark.createDataFrame(turns, TURNS).repartition(7).withColumn("node", F.lit("clash")).withColumn("chunk", F.lit(1))
    assert trie_rows(conversation_trie.conversation_trie(table)) == plain_trie(turns)


def test_trie_of_conversations_without_turns(spark):
    short = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    turns = [(c, 1, "u", "own") for c in short]  # their base is absent and their only turn is replaced
    assert trie_rows(conversation_trie.conversation_trie(spark.createDataFrame(turns, TURNS))) == plain_trie(turns)
    assert rows(conversation_trie.conversation_trie(spark.createDataFrame([], TURNS))) == []


def test_subtree_totals_of_any_tree(spark):
    rng = random.Random(9)
    parents = {0: None} | {i: rng.randrange(max(0, i - 3), i) for i in range(1, 400)} | {i: 0 for i in range(400, 900)}
    tree = spark.createDataFrame([(i, p, i % 7, 1) for i, p in parents.items()], "node long, parent long, x long, n long")
    want = {i: [i % 7, 1] for i in parents}
    for i in sorted(parents, reverse=True):
        if parents[i] is not None:
            up = max(i, 0)
            want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[up])]
    found = rows(conversation_trie.subtree_totals(tree, ["x", "n"]))
    assert len(found) == len(parents) and {r["node"]: [r["x"], r["n"]] for r in found} == want


def test_plan_of_subtree_totals_does_not_grow_with_rounds(spark):
    """The driver holds plans: it needed 1,500 MB when every round stayed a part of the last one."""
    def relations(length):
        chain = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(length)], "node long, parent long, n long")
        found = conversation_trie.subtree_totals(chain, ["n"])
        assert {r["node"]: r["n"] for r in rows(found)} == {i: length - i for i in range(length)}
        return found._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert relations(300) <= relations(12) <= 12


def test_lookup_keeps_rows_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(hot_keys, "SHARE", 10)
    left = spark.createDataFrame([(None if i % 5 == 4 else 0 if i % 2 else i, i) for i in range(300)], "k long, i long")
    right = spark.createDataFrame([(k, k * 2) for k in range(0, 300, 4)], "k long, v long")
    for how in ("left", "inner"):
        assert sorted(map(str, hot_keys.lookup(left, right, ["k"], how).collect())) == sorted(
            map(str, left.join(right, "k", how).collect()))


# 12. SimHash

def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Smallest index of each print's class by comparing all pairs."""
    values = np.array(prints, np.uint64)
    label = np.arange(len(values))
    while True:
        new = np.array([label[np.bitwise_count(values ^ v) <= radius].min() for v in values])
        if (new == label).all():
            return label.tolist()
        label = new


def test_prints_and_classes_of_the_given_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in rows(queries.op12_simhash(spark, sf))}
    ids = sorted(texts)
    prints = [plain_print(texts[i]) for i in ids]
    assert [found[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in ids] == [ids[k] for k in plain_components(prints)]


def crowd(rng, n, distance):
    centre = rng.getrandbits(64)
    return [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_trie_links_equal_all_pairs(spark, monkeypatch, small):
    if small:  # many nodes, many steps down, many halvings
        for name, value in (("AVERAGE", 8), ("MOST", 24), ("STEP", 3), ("_PAIRS", 64), ("_DIRECT", 2)):
            monkeypatch.setattr(simhash_dedup, name, value)
    rng = random.Random(17)
    prints = {0, 2**64 - 1, 1, *[rng.getrandbits(64) for _ in range(500)], *[rng.getrandbits(9) << 40 for _ in range(200)]}
    for n, distance in ((400, 2), (60, 5), (40, 9)):
        prints |= set(crowd(rng, n, distance))
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    links = rows(simhash_dedup.trie_links(spark.createDataFrame([(p,) for p in signed], "print long").repartition(5)))
    at = {p: i for i, p in enumerate(signed)}
    a, b = (np.array([at[r[c]] for r in links]) for c in "ab")
    assert simhash_dedup.star(len(prints), a, b).tolist() == plain_components(prints)
    # Links within a crowd stay far below its pairs.
    assert len(links) < 40 * len(prints)


def test_simhash_odd_and_empty(spark, odd, empty):
    found = rows(simhash_dedup.simhash_classes(odd))
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter((r["doc_id"], r["print"] % 2**64) for r in found) == Counter((i, plain_print(t)) for i, t in texts)
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert of[1] == of[2] == of[8] == 1 and of[4] == of[5] == 4 and of[None] is None
    assert rows(simhash_dedup.simhash_classes(empty)) == []


def test_a_long_text_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(simhash_dedup, "_HASHES", 1_000)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n)) for n in (1, 2, 3, 5_000, 10, 0, 1_002, 7)]
    assert simhash_dedup.fingerprint_of([t.encode() for t in texts]).tolist() == [plain_print(t) for t in texts]


# 13. cross-tokenizer alignment

@pytest.fixture(scope="session")
def paths():
    return queries.public_vocabulary("byte_bpe_50k.json"), queries.public_vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def tokenizers(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def decoded(tokenizers):
    """Bytes of a token of A and of B."""
    a, b = tokenizers
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    return lambda i: bytes(byte[c] for c in a.id_to_token(i)), of_b


def plain_alignment(text, tokenizers):
    """Ids of both and their groups; the ends are compared as sets."""
    bytes_a, bytes_b = map(lru_cache(None), decoded(tokenizers))
    a = tokenizers[0].encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = tokenizers[1].encode(text) if text else []
    raw = (" " + (text or "")).encode()
    if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
        return [], [], []
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((bytes_a, a), (bytes_b, b))]
    groups, x, y = [], 0, 0
    ranks = [{end: i + 1 for i, end in enumerate(e)} for e in ends]
    for end in sorted(set(ends[0]) & set(ends[1])):
        x1, y1 = ranks[0][end], ranks[1][end]
        groups.append((a[x:x1], b[y:y1]))
        x, y = x1, y1
    return a, b, groups


def plain_digest(texts, tokenizers):
    found = [plain_alignment(t, tokenizers) for t in texts]
    links = [[(x[-1], y[-1]) for x, y in groups] for _, _, groups in found]
    counts = Counter(p for of in links for p in of)
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for (a, b, groups), of in zip(found, links):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(of), sum(counts[p] == highest[p[1]] for p in of),
                    sum(counts[p] for p in of), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    None, "", " ", "\n", " lead", "tail \n ", "two  blanks\n\n three \t\n tabs", "carriage\r\nreturn;\r\n", "a▁b ▁ c", "<|endoftext|> <s> </s> <0x41>",
    "漢字 カナ Ünï😀 é", "x" * 3_000, "x" * 17 + " " * 40 + "y", "nul\x00 bell\x07 \x1c sep \x85 nel em　wide", "don't 'S we'll 123456 3.14!?", "ab\n cd\n  ef\n",
]


def test_alignment_digest_of_the_given_table(spark, sf, tokenizers):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    found = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in rows(queries.op13_token_alignment(spark, sf))}
    assert [found[i] for i in ids] == plain_digest([texts[i] for i in ids], tokenizers)


def test_alignment_of_odd_texts_in_small_chunks(spark, paths, tokenizers, monkeypatch):
    texts = [*ODD_TEXTS, *ODD_TEXTS[4:8], " ".join(f"word{i % 90}" for i in range(20_000))]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, links string, row long")
    found = rows(token_alignment.alignment_digest(docs, *paths))
    assert [tuple(r[n] for n in NAMES) for r in sorted(found, key=lambda r: r["doc_id"])] == plain_digest(texts, tokenizers)
    run = token_alignment._linked(*paths)  # the same in chunks of seven links, here without Spark
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(token_alignment, "TaskContext", Context)
    monkeypatch.setattr(token_alignment, "CHUNK", 7)
    monkeypatch.setattr(token_alignment, "KEPT", 6)
    monkeypatch.setattr(token_alignment, "PAIRS", 90)
    monkeypatch.setattr(token_alignment, "groups_of", lambda texts: ([t] for t in texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(ODD_TEXTS))), "text": pa.array(ODD_TEXTS)})
    links, entries = defaultdict(Counter), {}
    parts = [r for b in run(iter([batch])) for r in b.to_pylist()]
    for r in parts:
        if r["pairs"] is not None:
            entries[r["chunk"]] = r["pairs"]
            assert sum(r["counts"]) <= 7 + max(len(p["links"]) for p in parts if p["links"] is not None and p["chunk"] == r["chunk"])
    for r in parts:
        if r["pairs"] is None:
            links[r["row"]].update(entries[r["chunk"]][i] for i in r["links"])
    for i, text in enumerate(ODD_TEXTS):
        want = Counter((x[-1] << 32) | y[-1] for x, y in plain_alignment(text, tokenizers)[2])
        assert links[i] == want, text


def test_aligned_documents_slice_into_groups(spark, paths, tokenizers, empty):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    for r in rows(token_alignment.align_documents(docs, *paths)):
        a, b, groups = plain_alignment(ODD_TEXTS[r["doc_id"]], tokenizers)
        ends_a, ends_b = [0, *r["a_ends"]], [0, *r["b_ends"]]
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert [(a[x:x1], b[y:y1]) for x, x1, y, y1 in zip(ends_a, ends_a[1:], ends_b, ends_b[1:])] == groups
    assert rows(token_alignment.align_documents(empty, *paths)) == rows(token_alignment.alignment_digest(empty, *paths)) == []


def test_galloping_finds_what_sets_find():
    rng = np.random.default_rng(1)
    for n, m, span in ((0, 5, 9), (5, 0, 9), (1, 1, 1), (50, 4_000, 5_000), (4_000, 50, 5_000), (900, 1_000, 1_100), (30, 900, 100_000)):
        a, b = (np.sort(rng.choice(span, min(k, span), replace=False)) for k in (n, m))
        at_a, at_b = token_alignment.common_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    skewed = np.concatenate([np.arange(10), np.arange(10_000, 20_000)])
    assert token_alignment.gallop(np.array([3, 9_999, 15_000, 30_000]), skewed).tolist() == [3, -1, 5_010, -1]


def test_another_operator_frees_what_a_worker_remembers():
    from depotlens.llm import near_dedup, quality_classifier, shingles

    for task, words_stay in ((near_dedup._sketched, True), (quality_classifier._measured, False)):
        shingles.word_hashes("some words of a text")
        token_output.word_encoder(queries.public_vocabulary())
        list(task(iter([])))
        assert token_output.word_encoder.cache_info().currsize == 0
        assert bool(shingles._hashes()) == words_stay


def test_finished_tasks_hold_no_words_and_texts_are_taken_in_pieces(monkeypatch):
    from depotlens.llm import decontamination, near_dedup, shingles

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3_000)), "text": [f"some words of text {i}" for i in range(3_000)]})
    seen, leaks = [], decontamination.Searcher.leaks
    monkeypatch.setattr(decontamination.Searcher, "leaks", lambda self, texts: seen.append(len(texts)) or leaks(self, texts))
    found = list(decontamination._filtering([(1, "an item of the benchmark with words")])(iter([batch])))
    assert sum(b.num_rows for b in found) == sum(seen) == 3_000 and max(seen) <= 512
    assert not shingles._hashes()
    pairs = pa.RecordBatch.from_pydict({"a": [2], "b": [1], "text_a": ["one two three"], "text_b": ["one two three"]})
    assert [b["similarity"].to_pylist() for b in near_dedup._compared(iter([pairs]))] == [[1.0]]
    assert not shingles._hashes()
