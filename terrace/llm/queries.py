"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import bpe, chat, exact, imatch, minhash, mixing, negatives, quality, suffix, tokencount, toxicity, whiten, winnow
from terrace.llm.common import read
from terrace.llm.vectors import floored, usable

#: The public vocabulary files; operators take a file's path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
PIECE_BPE = f"{TOKENIZERS}/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_chat_formatting", """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  coalesce(CAST(floor(turn / 256.0) AS BIGINT), -4611686018427387904) AS block FROM t),
marked AS (SELECT *, md5(concat(k, chr(1), md5(role), md5(text))) AS m FROM placed),
rolled AS (SELECT conv_id, k, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY k)) AS h,
  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM marked),
whole AS (SELECT k, h, min(conv_id) AS conv_id FROM rolled WHERE k = n_turns GROUP BY k, h),
kept AS (SELECT conv_id FROM whole w WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.k < r.n_turns AND r.k = w.k AND r.h = w.h))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY block) AS INTEGER) AS part, min(k) AS first_turn,
 sum(count(*)) OVER (PARTITION BY conv_id)::BIGINT AS n_turns,
 string_agg('<|im_start|>' || CASE WHEN trim(role) = '' THEN 'user' ELSE replace(lower(trim(role)), '<|', '< |') END || chr(10)
  || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, block""")
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(read(spark, folder, "conversations"))


@query("op2_minhash_near_dedup")
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"), words=2)


@query("op3_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(read(spark, folder, "documents"))


#: Wanted shares of the languages in the mix.
LANGUAGE_TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: the language of the labelled documents."""
    ids = labels.select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")


@query("op4_mixing")
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return mixing.mixing_rates(docs, labelled_domains(docs, labels), LANGUAGE_TARGETS)


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(read(spark, folder, "documents"), WORD_BPE)


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, folder, "documents"), digests=True)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(read(spark, folder, "documents"), PIECE_BPE)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Graded ratings: 0 poor, 1 good but toxic, 2 good and clean."""
    ratings = read(spark, folder, "labels").select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).alias("grade"))
    return quality.grade_documents(read(spark, folder, "documents"), ratings)


@query("op10_document_fingerprints")
def op10_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(read(spark, folder, "documents"))


@query("op11_hard_negatives")
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").where(usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), floored("embedding").alias("x"), (F.col("vec_id") % 100 == 0).alias("anchor")))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings").where(usable("embedding"))
    return whiten.whiten(rows.select("vec_id", floored("embedding").alias("x")))


@query("op13_benchmark_decontamination", r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS words FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT k, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d JOIN sizes ON len(ws) >= n),
hit AS (SELECT k, i, n, item_id FROM (SELECT k, i, n, array_to_string(ws[i:i + n - 1], ' ') AS words FROM dw) JOIN win USING (n, words)),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)""")
def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
