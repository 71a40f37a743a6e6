"""Benchmark passages inside documents: size-partitioned MinHash containment search, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept_rows, materialize, mix, ready, slices, trimmed, union, utf8
from millrace.llm.textnum import distinct, shingle_hashes, word_hashes

PERMUTATIONS, LEAST, WORDS = 48, 0.75, 5
#: Smallest size class: items of up to so many shingles.
BASE = 8
_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


class Items:
    """A block of test items: shingle sets, and MinHash tables of each size class."""

    def __init__(self, texts: pa.Array) -> None:
        sets, at = distinct(*shingle_hashes(*word_hashes(*utf8(texts)), WORDS))
        self.sets, self.at = sets, at
        n = np.diff(at)
        level = np.ceil(np.log2(np.maximum(n, 1) / BASE)).clip(0).astype(int)  # size <= BASE << level
        self.levels = []
        for k in sorted(set(level[n > 0].tolist())):
            own = np.flatnonzero((level == k) & (n > 0))
            sig = np.stack([(mix(sets[at[i] : at[i + 1]])[:, None] * _SEEDS >> np.uint64(32)).astype(np.uint32).min(0) for i in own])
            seen = np.zeros((PERMUTATIONS, 8192), np.uint8)
            for p in range(PERMUTATIONS):
                low = sig[:, p] & 0xFFFF
                np.bitwise_or.at(seen[p], low >> 3, (1 << (low & 7)).astype(np.uint8))
            order = [np.argsort(sig[:, p], kind="stable") for p in range(PERMUTATIONS)]
            self.levels.append((k, own, [sig[o, p] for p, o in enumerate(order)], order, seen))
        # items of up to BASE shingles are too short for MinHash alone: their shingles are looked up one by one
        few = np.flatnonzero((n > 0) & (n <= BASE))
        tokens = np.concatenate([np.zeros(0, np.uint64), *(sets[at[i] : at[i + 1]] for i in few)])
        turn = np.argsort(tokens, kind="stable")
        self.short, self.short_item = tokens[turn], np.repeat(few, n[few])[turn]
        self.short_seen = np.zeros(1 << 17, np.uint8)
        low = self.short & np.uint64((1 << 20) - 1)
        np.bitwise_or.at(self.short_seen, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def short_pairs(self, sh: np.ndarray, so: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for each shingle of a short item that a text has."""
        low = sh & np.uint64((1 << 20) - 1)
        at = np.flatnonzero(self.short_seen[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        a, b = (np.searchsorted(self.short, sh[at], side) for side in ("left", "right"))
        at, a, b = (x[b > a] for x in (at, a, b))
        doc = np.searchsorted(so, at, "right") - 1
        return {(d, int(i)) for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True) for i in self.short_item[x:y]}

    def find(self, sh: np.ndarray, so: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, shared, size) of all contained items, given the shingles of some texts in order.

        Each text is cut in blocks of BASE shingles (the last may be shorter); a size class compares items of up
        to s shingles with windows of 2 s, half overlapping, so long texts don't drown short items. Equal minima
        at one of 48 permutations make a candidate, and so does any shingle of an item of up to BASE shingles; the
        candidate's whole shingle set is then looked up in the whole text.
        """
        n = np.diff(so)
        if not len(sh) or not self.levels:
            return []
        blocks = -(-n // BASE)
        bo = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(n)), blocks)
        first = so[doc] + (np.arange(bo[-1]) - bo[doc]) * BASE
        m, pairs = mix(sh), self.short_pairs(sh, so)
        for p in range(PERMUTATIONS):
            low = np.minimum.reduceat((m * _SEEDS[p] >> np.uint64(32)).astype(np.uint32), first)
            d, start, at = doc, bo, 0
            for k, own, table, order, seen in self.levels:
                while at < k:  # blocks twice as long
                    size = np.diff(start)
                    half = -(-size // 2)
                    new = np.concatenate([[0], np.cumsum(half)])
                    d = np.repeat(np.arange(len(n)), half)
                    low, start, at = np.minimum.reduceat(low, start[d] + 2 * (np.arange(new[-1]) - new[d])), new, at + 1
                both = low.copy()
                same = d[1:] == d[:-1]
                both[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                key = both & 0xFFFF
                for w in np.flatnonzero(seen[p][key >> 3] >> (key & 7).astype(np.uint8) & 1):
                    a = np.searchsorted(table[p], both[w], "left")
                    for i in order[p][a : np.searchsorted(table[p], both[w], "right")]:
                        pairs.add((int(d[w]), int(own[i])))
        out, held, last = [], np.zeros(0, np.uint64), -1
        for t, i in sorted(pairs):
            if t != last:
                held, last = np.unique(sh[so[t] : so[t + 1]]), t
            item = self.sets[self.at[i] : self.at[i + 1]]
            shared = int((held[np.minimum(np.searchsorted(held, item), len(held) - 1)] == item).sum())
            if shared * 100 >= len(item) * int(LEAST * 100):
                out.append((t, i, shared, len(item)))
        return out


def blocks_of(benchmark: DataFrame, block: int) -> Iterator[tuple[list, Items]]:
    """Ids and index of the items, block by block: texts of ``block`` bytes, or one text that is longer."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        if part and size + len(r[1]) > block:
            yield [x[0] for x in part], Items(pa.array([x[1] for x in part], pa.string()))
            part, size = [], 0
        part.append(r)
        size += len(r[1])
    if part:
        yield [x[0] for x in part], Items(pa.array([x[1] for x in part], pa.string()))


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where a document has 75 % or more of an item's distinct 5-word shingles.

    Words as in the other operators (A-Z lower-cased, cut at white space); an item of fewer than five words is
    one shingle, which only an equal text has. Items or texts without words match nothing; null ids are kept.
    Items come in blocks of ``block`` bytes of text, each broadcast, so memory is bounded at any number of items;
    documents are read once for each block. Repeated rows give repeated results, empty tables none; other columns
    are ignored. Documents do not shuffle.
    """
    spark = ready(docs.sparkSession)
    found = []
    for ids, index in blocks_of(benchmark, block):
        items, names = spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(ids)

        @trimmed
        def search(batches, items=items, names=names):
            for batch in batches:
                for b in slices(batch, "text"):
                    hits = items.value.find(*shingle_hashes(*word_hashes(*utf8(b.column(1))), WORDS))
                    ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([names.value[h[1]] for h in hits], pa.int64()), *(pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3))], ["doc_id", "item_id", "n_shared", "n_item"])

        found.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long")
    return union(found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block: int = 16 << 20) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, all columns kept; nothing shuffles.

    Each row is judged by its own text, so null and repeated doc_ids are no matter; texts and items as in leaks().
    Survivors of a block of items are written before the next block.
    """
    spark, left = ready(docs.sparkSession), None
    for _, index in blocks_of(benchmark, block):
        items = spark.sparkContext.broadcast(index)

        def clean(texts, items=items):
            out = np.ones(len(texts), bool)
            out[[h[0] for h in items.value.find(*shingle_hashes(*word_hashes(*utf8(texts)), WORDS))]] = False
            return out

        left = kept_rows(docs if left is None else materialize(left, "clean"), clean)
    return docs if left is None else left
