"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import ctw, decontaminate, near_dups, packing, quality_classifier, quality_rules, secrets, substring_dedup, token_counts, warc
from ._common import shared_dir, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ratios = secrets.train(secrets.labelled_samples(documents, table(spark, sf_dir, "labels")))
    return secrets.report(secrets.find_secrets(documents.select("doc_id", "text"), ratios))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).drop("payload")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_decontamination, op4_secret_scans, op5_near_duplicates, op6_warc, op7_quality_classifier, op8_best_fit_packing, op9_substring_dedup, op10_lm_scoring)}

#: From the contract alone: equal payloads are found by the text itself, and base32 is made of five bits of the SHA-1 a letter.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
t AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top, sha1(encode(html)) AS hex FROM p)
SELECT page_id,
       CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM t
"""

#: Windows are compared as texts of 13 words joined by a blank, which no word contains.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS lo FROM k GROUP BY win),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS place FROM k JOIN f USING (win) WHERE lo < doc_id),
g AS (SELECT r, list(place) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
ORACLES = {"op6_warc": OP6_SQL, "op9_substring_dedup": OP9_SQL}
