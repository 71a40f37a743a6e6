"""The registered query of each operator, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read
from millrace.llm.decontam import leaks
from millrace.llm.exact import exact_groups
from millrace.llm.gru import lm_scores
from millrace.llm.langid import predict_languages
from millrace.llm.ngramjoin import near_groups
from millrace.llm.packing import pack
from millrace.llm.planes import token_table
from millrace.llm.secrets import secret_table
from millrace.llm.substr import remove_repeats
from millrace.llm.toxicity import predict_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_table(read(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secrets, op3_token_planes, op4_substrings, op5_exact_dedup, op6_packing, op7_decontamination, op8_toxicity, op9_gru_scores, op10_ngram_join)}


_EXACT = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha)
"""

_SHINGLES = r"""
{0}w AS (SELECT id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM {1}),
{0}s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM {0}w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0)"""

_LEAKS = f"""
WITH {_SHINGLES.format('d', '(SELECT doc_id AS id, text FROM documents)')},
{_SHINGLES.format('b', '(SELECT item_id AS id, text FROM benchmark)')},
n AS (SELECT id, count(*) AS n_item FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN bs USING (sh) JOIN n ON n.id = bs.id
GROUP BY ds.id, bs.id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _EXACT, "op7_decontamination": _LEAKS}
