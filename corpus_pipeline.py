"""Cleans and packs the documents table: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import delete, read, ready, release, scratch_path
from millrace.llm.decontam import drop_leaks
from millrace.llm.exact import drop_repeats
from millrace.llm.langid import with_language
from millrace.llm.ngramjoin import drop_near
from millrace.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no language (null, without letters, or mostly noise) go, each by its own text.

    Doc_ids may be null or repeat, other columns are kept whatever their names, and an empty table stays empty.
    """
    release(ready(spark))
    return with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white-space runs as one space, null as empty) one row stays: that of the smallest doc_id, null ids last.

    Rows with a text of their own stay, also under a null or repeated doc_id; all columns are kept; an empty table stays empty.
    """
    release(ready(spark))
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that 5-word shingles link (Jaccard >= 0.75), directly or not, one stays: that of the smallest doc_id, null ids last.

    Rows count by doc_id and text, so null and repeated ids are no matter. Texts without words link with nothing and
    stay; all columns are kept; an empty table stays empty.
    """
    release(ready(spark))
    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds 75 % or more of a benchmark item's 5-word shingles go, each by its own text.

    Null and empty texts and items match nothing; all columns are kept; an empty table (of either kind) changes nothing.
    """
    release(ready(spark))
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids.

    Null and empty texts have the end id alone; rows that repeat a doc_id count as documents each; an empty table gives no rows.
    """
    release(ready(spark))
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express tokenization, language mixtures or connected components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written; what a stage has read is deleted once the next has been written."""
    docs, before = read(spark, sf_dir, "documents"), None
    base = scratch_path(spark, "pipeline", keep=True)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)  # each stage starts by dropping the scratch tables of the one before
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    release(spark)
    return docs
