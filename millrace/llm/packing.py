"""Order-preserving packing by dynamic programming over window cuts."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ready, slices, trimmed
from millrace.llm.tokens import default_vocabulary, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Cost of a cut, in padding tokens: between documents, after a sentence, inside a sentence.
DOCUMENT, SENTENCE, INSIDE = 0, 4, 12


def cuts(points: np.ndarray, cost: np.ndarray, room: int) -> list[int]:
    """Positions of the best cuts of a stream that may be cut at ``points`` (ascending, from 0, gaps <= room).

    best[j] = cost[j] + room - points[j] + min over points[j] - points[i] <= room of best[i] + points[i]: padding
    is linear in the window, so a queue of rising values gives each minimum in constant time. A last window
    shorter than ``room`` costs its cut alone, since the tail is split in powers of two, which need no padding.
    """
    p, c = points.tolist(), cost.tolist()
    last = len(p) - 1
    best, back = [0.0] * (last + 1), [0] * (last + 1)
    queue: deque = deque([(0, 0)])  # (best + point, index), values rising
    for j in range(1, last + 1):
        x = p[j]
        low = x - room
        while p[queue[0][1]] < low:
            queue.popleft()
        v, i = queue[0]
        b = best[j] = (c[j] + room - x + v) if j < last else 0
        back[j] = i
        if j == last:
            i = min((k for _, k in queue), key=lambda k: best[k] + DOCUMENT)
            back[j] = i
            break
        v = b + x
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
    out, j = [last], last
    while j:
        j = back[j]
        out.append(j)
    return [p[k] for k in reversed(out)]


def windows(sizes: np.ndarray, sentence_ends: np.ndarray, room: int) -> np.ndarray:
    """Bounds of the sequences of a stream of documents of ``sizes`` ids; sentence_ends are stream positions."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(1, np.int64)
    ends = np.cumsum(sizes)
    at = np.unique(np.concatenate([[0], ends, sentence_ends[sentence_ends < total]]))
    gap = np.diff(at)
    step = max(1, room // 64)
    long = np.flatnonzero(gap > 2 * step)  # a long stretch may also be cut inside
    more = [np.arange(at[k] + step, at[k + 1], step) for k in long]
    points = np.unique(np.concatenate([at, *more])).astype(np.int64)
    cost = np.full(len(points), INSIDE, np.float64)
    cost[np.isin(points, sentence_ends)] = SENTENCE
    cost[np.isin(points, ends)] = DOCUMENT
    bounds = cuts(points, cost, room)
    tail, start = bounds[-1] - bounds[-2], bounds[-2]
    bits = [1 << k for k in range(int(tail).bit_length() - 1, -1, -1) if tail >> k & 1]
    return np.array([*bounds[:-1], *(start + np.cumsum(bits)).tolist()], np.int64)


def pack(docs: DataFrame, room: int = 2048, vocabulary: str | None = None, end_id: int = 1, stream: int = 1 << 20) -> DataFrame:
    """Pieces of all docs (doc_id, text) in sequences of at most ``room`` ids, in doc_id order.

    Streams of about ``stream`` ids of neighbouring documents are cut independently; a document never spans two
    streams, however long. Null and empty texts have ``end_id`` alone. Rows that repeat a doc_id each count as a
    document; a null doc_id stays null. An empty table gives no rows; other columns are ignored.
    A sequence's number is its task, then its place there.
    """
    ready(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    @trimmed
    def run(batches):
        enc, number = encoder(vocabulary), TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def flush():
            nonlocal number
            doc = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            base = np.cumsum([0, *[len(h[2]) for h in held[:-1]]])
            stops = np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)])
            bounds = windows(sizes, stops, room)
            ends = np.cumsum(sizes)
            cut = np.union1d(bounds, np.concatenate([[0], ends]))
            lo, hi = cut[:-1], cut[1:]
            d = np.searchsorted(ends, lo, "right")
            w = np.searchsorted(bounds, lo, "right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            out = [doc.take(pa.array(d)), *map(pa.array, (lo - (ends - sizes)[d], hi - lo)), pa.array(crc, pa.int64()), *map(pa.array, (sizes[d], number + w, lo - bounds[w]))]
            number += len(bounds) - 1
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for b in slices(batch, "text"):
                ids, off, stops = enc.encode(b.column(1), sentences=True)
                shift = np.searchsorted(off[1:], stops, "left")  # end ids before each stop
                held.append((b.column(0), np.diff(off) + 1, np.insert(ids, off[1:], np.uint32(end_id)), stops + shift))
                if sum(len(h[2]) for h in held) >= stream:
                    yield flush()
                    held = []
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, PIECES)
