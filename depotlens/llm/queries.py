"""Registered queries of the training-data operators and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import (
    conversation_trie, decontamination, license_scan, mixing, near_dedup, pii, quality_classifier, quality_rules,
    sharding, simhash_dedup, suffix_dedup, token_alignment, token_output,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    )
    placed = sharding.shard_documents(docs, 24, carry=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources at weights 5, 2, 1 takes from every document."""
    taken, _ = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontamination.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and base places of all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages of 400 bytes take from every document."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents and the verdict of the rule cascade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_cascade(docs, report=True)
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judged.select("doc_id", *[F.col("measures")[c].alias(c) for c in shown], "kept")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *shown, failed.alias("base_failed"), "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS u(i)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + j) AS n FROM dup, unnest(range(8)) AS u(j) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims
  FROM d LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words AND 100 * n_symbols <= 5 * word_chars
         AND 100 * n_exclaims <= 30 * n_words AND (n_dup_lines <= 3 OR 100 * n_dup_lines <= 30 * n_lines)
         AND word_chars BETWEEN 2 * n_words AND 20 * n_words AS kept
FROM m
"""


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from positives outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced, and how much of each kind there was."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rewritten = pii.pseudonymize(docs, key="example key of the registered query")
    return rewritten.select("doc_id", "text", *pii.found_counts(F.col("found")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and read back."""
    path = token_output.scratch_path(spark, "tokens")
    token_output.write_token_files(table(spark, sf_dir, "documents"), path, public_vocabulary(), end_id=2)
    return token_output.token_digest(spark, path)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with its subtree totals."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("node")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash_dedup.simhash_classes(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers over all documents."""
    return token_alignment.alignment_digest(
        table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_simhash": op12_simhash,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op7_quality_rules": OP7_SQL}
