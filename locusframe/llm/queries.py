"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusframe.llm.alignment import align_tokenizers
from locusframe.llm.common import table
from locusframe.llm.languages import held_out_languages
from locusframe.llm.minhash import near_duplicates
from locusframe.llm.mixing import mix_probabilities
from locusframe.llm.packing import pack_documents
from locusframe.llm.pii import pseudonymise
from locusframe.llm.quality import BASE_COUNTS, quality_cascade
from locusframe.llm.secret_links import secret_digest
from locusframe.llm.spelling import spelling_variants
from locusframe.llm.syncmers import fingerprint_edits
from locusframe.llm.token_store import store_digest
from locusframe.llm.toxicity import toxicity
from locusframe.llm.url_filter import filter_urls

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR") or str(Path(public_tokenizers.path("byte_bpe_50k.json")).parent)
#: The key of the pseudonyms; a deployment sets its own.
PII_KEY = os.environ.get("PII_KEY", "corpus-2024")
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, per_cent=80)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_digest(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), features=True)
    return judged.select("doc_id", *BASE_COUNTS, "base_failed", "kept")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", size=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_probabilities(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_token_store,
        op3_quality_rules,
        op4_best_fit_packing,
        op5_pii_pseudonyms,
        op6_mixing,
        op7_syncmer_fingerprints,
        op8_secret_links,
        op9_toxicity,
        op10_url_filter,
        op11_spelling_variants,
        op12_language_id,
        op13_token_alignment,
    )
}
#: Verdicts do not depend on the order of the rules, so SQL can give op3 whole; the
#: others need hashes, models, tokens or positions of matches and are tested by brute force.
ORACLES: dict[str, str] = {
    "op3_quality_rules": r"""
WITH f AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM f LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 5 * n_symbols <= n_words
       AND 5 * n_dup_lines <= 3 * greatest(1, n_lines) AND 2 * n_digits <= word_chars AND 2 * n_upper <= word_chars AS kept
FROM judged""",
}
