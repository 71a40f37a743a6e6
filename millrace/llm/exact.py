"""Exact deduplication with two passes over a Bloom filter of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WS, Bits, attach, fresh, holder, materialize, may_hold, named, one_of_each, ready, scratch_path, trimmed

#: Rows that one filter is built for, 16 bits each; more rows go in rounds of hash ranges, a filter each.
ROUND = 1 << 24


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "), 256)


def flagged(digests: DataFrame, rows: int) -> DataFrame:
    """(doc_id, sha) with ``maybe``: whether the hash may occur more than once.

    Pass one counts hash slots, saturating at two; pass two tests each row. A filter has 16 bits a row. More than
    ROUND rows go in rounds, each with the filter of its range of hashes, so a broadcast is bounded at any input
    size; ``digests`` lies sorted by hash within its files, so a round reads its own part of them.
    """
    spark = ready(digests.sparkSession)
    rounds = max(1, -(-rows // ROUND))
    path = scratch_path(spark, "marked")
    for k in range(rounds):
        own = digests
        if rounds > 1:
            low, high = (-(1 << 63) + (j << 64) // rounds for j in (k, k + 1))
            own = own.filter((F.col("h") >= low) & (F.col("h") <= high - 1))
        shared = spark.sparkContext.broadcast(Bits(min(rows, ROUND), planes=2).build(own.select("h"), "h"))

        @trimmed
        def test(batches, shared=shared):
            for b in batches:
                hit = shared.value.test(np.asarray(b.column(2), np.int64), 1) if len(b) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit)], ["doc_id", "sha", "maybe"])

        own.select("doc_id", "sha", "h").mapInArrow(test, "doc_id long, sha string, maybe boolean").write.parquet(f"{path}/round={k}")
        shared.unpersist()
    return spark.read.schema("doc_id long, sha string, maybe boolean, round int").parquet(path).drop("round")


def _digests(docs: DataFrame) -> tuple[DataFrame, int]:
    """The written (doc_id, sha, h) of all rows, and their number."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha")).withColumn("h", F.xxhash64("sha"))
    out = materialize(each.sortWithinPartitions("h"), "digest")
    return out, out.count()


def exact_groups(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after white-space runs become one space; null counts as empty. The row with
    the smallest doc_id stays (rows that repeat that doc_id stay too; null ids come last and stay only where
    a group has no other). An empty table gives no rows; columns other than doc_id and text are not read.
    Only rows whose hash may repeat shuffle, without their text.
    """
    digests, rows = _digests(docs)
    marked = flagged(digests, rows)
    alone = marked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    some = marked.filter("maybe").select("doc_id", "sha")
    groups = some.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    every = alone.unionByName(attach(some, groups, ["sha"], "group_size", rows).select(*alone.columns))
    return every.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.col("sha").alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts (as in exact_groups), all columns kept whatever their names.

    The row with the smallest doc_id stays, of ties the one whose text as it stands sorts first; rows without doc_id
    come last. A row with a text of its own stays, whether its doc_id is null or repeated. An empty table stays empty.
    Rows that the filter clears pass straight through; equal ones among the others are combined before they shuffle.
    """
    digests, rows = _digests(docs)
    marked = flagged(digests, rows)
    # the hashes that do occur more than once: few against the rows, and known by a filter of their own
    again = materialize(marked.filter("maybe").groupBy("sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha"), "again")
    sha, may = fresh(docs, "sha", "may")
    rows = docs.withColumn(sha, digest(F.col("text"))).withColumn(may, may_hold(holder(again, "sha"))(F.col(sha)))
    id_ = F.col("doc_id").cast("long")
    some = one_of_each(rows.filter(F.col(may)).drop(may), sha, [id_.isNull(), id_, F.coalesce("text", F.lit(""))])
    return rows.filter(~F.col(may)).select(*map(named, docs.columns)).unionByName(some)
