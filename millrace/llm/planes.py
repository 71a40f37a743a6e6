"""Token ids as binary shards: fixed-size blocks, transposed to byte or bit planes, zstandard, a chunk index.

A shard is one blob: the header ``MRP1``, the plane kind, the ids in a block; a table of blocks (ids, planes,
compressed size of each plane); a compressed table of documents (doc_id, ids); then the planes of each block.
Shards are rows of a Parquet folder ordered by (part, seq), so Spark commits and reads them on any store; ``first``
counts the ids of the part before a shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ready, scratch_path, slices, trimmed
from millrace.llm.tokens import default_vocabulary, encoder

MAGIC = b"MRP1"
_HEAD = struct.Struct("<4sBIIIQ")
SHARD = "part int, seq int, first long, n_docs long, n_ids long, blob binary"


def split_planes(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """The non-empty planes of a block: plane k has byte (or bit) k of each id."""
    if kind == "byte":
        raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
        top = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 0
        return [np.ascontiguousarray(raw[k]) for k in range(top)]
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little") for k in range(top)]


def join_planes(planes: list[np.ndarray], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= (p if kind == "byte" else np.unpackbits(p, count=n, bitorder="little")).astype(np.uint32) << np.uint32(k * (8 if kind == "byte" else 1))
    return out


def pack_shard(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, kind: str = "byte", block: int = 1 << 16) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    table, body = [], []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        packed = [z.compress(p.tobytes()) for p in split_planes(part, kind)]
        table.append(struct.pack(f"<IB{len(packed)}I", len(part), len(packed), *map(len, packed)))
        body += packed
    docs = z.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes())
    index = b"".join(table)
    return _HEAD.pack(MAGIC, kind == "bit", block, len(table), len(docs), len(index)) + index + docs + b"".join(body)


def _index(blob: bytes) -> tuple[str, int, list, bytes]:
    magic, bit, block, blocks, n_docs, n_index = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at, rows = _HEAD.size, []
    pos = at + n_index + n_docs
    for _ in range(blocks):
        n, planes = struct.unpack_from("<IB", blob, at)
        size = struct.unpack_from(f"<{planes}I", blob, at + 5)
        rows.append((n, pos, size))
        at, pos = at + 5 + 4 * planes, pos + sum(size)
    return "bit" if bit else "byte", block, rows, blob[_HEAD.size + n_index : _HEAD.size + n_index + n_docs]


def read_shard(blob: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a shard; only the blocks that hold them are decompressed."""
    kind, block, rows, _ = _index(blob)
    total = sum(r[0] for r in rows)
    stop = total if stop is None else min(stop, total)
    z, out = zstandard.ZstdDecompressor(), []
    for b in range(start // block, -(-stop // block) if stop > start else start // block):
        n, pos, size = rows[b]
        planes = []
        for s in size:
            planes.append(np.frombuffer(z.decompress(blob[pos : pos + s]), np.uint8))
            pos += s
        out.append(join_planes(planes, n, kind))
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    base = start // block * block
    return ids[start - base : max(start, stop) - base]


def shard_documents(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and number of ids of each document of a shard, in order."""
    raw = zstandard.ZstdDecompressor().decompress(_index(blob)[3])
    both = np.frombuffer(raw, "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]


def write_token_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, kind: str = "byte", shard_ids: int = 4 << 20) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order and write their shards to ``path``.

    Each document ends with ``end_id``; null and empty texts have that id alone. Ties of doc_id are ordered by
    text; rows without doc_id come first under id -1. A document lies in one shard, however long it is. An
    empty table writes no shard. Other columns are ignored.
    """
    ready(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    @trimmed
    def shards(batches):
        part, seq, first, held = TaskContext.get().partitionId(), 0, 0, [empty]
        enc = encoder(vocabulary)

        def flush():
            d, n, i = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first": [first], "n_docs": [len(d)], "n_ids": [len(i)], "blob": pa.array([pack_shard(d, n, i, kind)], pa.binary())})

        for batch in batches:
            for b in slices(batch, "text"):
                ids, off, _ = enc.encode(b.column(1))
                held.append((np.asarray(b.column(0)), np.diff(off) + 1, np.insert(ids, off[1:], np.uint32(end_id))))
                size = sum(len(h[2]) for h in held)
                if size >= shard_ids:
                    yield flush()
                    held, seq, first = [empty], seq + 1, first + size
        if len(held) > 1:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARD).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32.

    One number for each task that wrote shards goes through the driver, 8 bytes each, however many shards it wrote.
    """
    ready(spark)
    table = spark.read.schema(SHARD).parquet(path)
    sizes = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).toLocalIterator()}
    starts = np.zeros(max(sizes, default=-1) + 2, np.int64)
    starts[[p + 1 for p in sizes]] = list(sizes.values())
    base = spark.sparkContext.broadcast(np.cumsum(starts))

    @trimmed
    def decode(batches):
        for b in batches:
            for part, first, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                doc, n = shard_documents(blob)
                raw = memoryview(read_shard(blob).astype("<u4").tobytes())
                end = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(base.value[part] + first + end - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "first", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs as shards (to a scratch folder unless ``path`` is given) and read them back: doc_id, start, n_tokens, ids_crc32.

    Nulls, ties, repeated rows and empty tables as in write_token_shards(); a null doc_id comes back as -1.
    """
    path = path or scratch_path(docs.sparkSession, "shards")
    write_token_shards(docs, path, vocabulary)
    return read_token_shards(docs.sparkSession, path)
