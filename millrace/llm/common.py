"""Scratch tables, hot-key joins and bounded filters that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and the control characters 9 to 13.
WS = r"[\x20\x09-\x0D]+"
_scratch: dict[str, list[str]] = {}
_local: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, also where the driver found it by its working folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    # whole texts make large batches: a fifth of Spark's default of rows, unless the session has a number of its own
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names.

    Only on one machine (master local) a temporary folder stands in for a missing setting; a cluster needs it.
    release() deletes the path unless ``keep``; what is left goes when the JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = f"file://{_local[app]}"
    path = f"{base.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)
    if not keep:
        _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    # row groups of 16 MB: a writer buffers one whole, a reader loads its column chunks whole
    df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what has been written
    return out


def release(spark: SparkSession) -> None:
    """Delete the scratch tables written so far; frames that still read them must have been written."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has (in any case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def named(column: str):
    """A column by its exact name, whatever signs it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold(mod: int):
    """crc32 of doc_id as text, modulo mod."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row per key, safe for hot keys.

    ``groups[count]`` is the number of rows of a key and ``total`` the number of all rows: at most 1,000
    keys can hold a thousandth of all rows each, so those are broadcast; the others shuffle and none is hot.
    """
    limit = max(64, total // 1000)
    hot = F.broadcast(groups.filter(F.col(count) >= limit))
    warm = rows.join(hot, keys)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(count) < limit), keys)
    return warm.unionByName(cold)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about ``most`` bytes of that text column (or one row)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.frombuffer(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64()).buffers()[1], np.int64)[: len(col)]
    at, total = 0, np.cumsum(size)
    while at < len(col):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and else keep the peak of every task they have run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back at the end of each task."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Bits:
    """A Bloom filter of at most 2**28 bits (32 MB a plane), whatever the input.

    Beyond the size it was planned for only its false positives grow, never false negatives.
    Two planes: a slot hit at least once, and hit at least twice.
    """

    HASHES, CHUNK, MOST = 3, 1 << 16, 1 << 28

    def __init__(self, keys: int, planes: int = 1) -> None:
        self.size = min(self.MOST, max(self.CHUNK, 1 << int(np.ceil(np.log2(max(1, keys) * 16)))))
        self.planes = planes
        self.bits: np.ndarray | None = None

    def slots(self, h: np.ndarray) -> np.ndarray:
        m = mix(h.view(np.uint64) if h.dtype != np.uint64 else h)
        a, b = m & np.uint64(0xFFFFFFFF), (m >> np.uint64(32)) | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) & np.uint64(self.size - 1) for i in range(self.HASHES)]).astype(np.int64)

    def test(self, h: np.ndarray, plane: int = 0) -> np.ndarray:
        s = self.slots(h)
        return ((self.bits[plane][s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool).all(0)

    def build(self, df: DataFrame, column: str) -> "Bits":
        """Fill it from a 64-bit column: tasks send the slots they hit, which are counted chunk by chunk on the executors."""
        slots, chunk, planes = self.slots, self.CHUNK, self.planes

        def hit(keys):
            """(chunk, slots hit there), a slot that several keys hit twice."""
            found = []
            for s in slots(np.concatenate(keys)):
                u, n = np.unique(s, return_counts=True)
                found += [u, u[n > 1]]
            s = np.sort(np.concatenate(found))
            cuts = np.flatnonzero(np.diff(s // chunk, prepend=-1))
            blobs = [zlib.compress(x.astype("<u2").tobytes(), 1) for x in np.split(s % chunk, cuts[1:])] if len(s) else []
            return pa.RecordBatch.from_arrays([pa.array(s[cuts] // chunk, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "counts"])

        @trimmed
        def partial(batches):
            held = [np.zeros(0, np.int64)]
            for b in batches:
                held.append(np.asarray(b.column(0).drop_null(), np.int64))
                if sum(map(len, held)) > 1 << 20:
                    yield hit(held)
                    held = [np.zeros(0, np.int64)]
            yield hit(held)

        @trimmed
        def merge(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for c, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    part = np.bincount(np.frombuffer(zlib.decompress(z), "<u2"), minlength=chunk).clip(0, 2).astype(np.uint8)
                    held[c] = np.minimum(2, held[c] + part) if c in held else part
            packed = [b"".join(np.packbits(held[c] > p, bitorder="little").tobytes() for p in range(planes)) for c in held]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["chunk", "counts"])

        ready(df.sparkSession)
        chunks = self.size // chunk
        parts = df.select(F.col(column).cast("long").alias("h")).mapInArrow(partial, "chunk long, counts binary")
        parts = parts.repartition(min(chunks, 256), "chunk").mapInArrow(merge, "chunk long, counts binary")
        self.bits = np.zeros((planes, self.size // 8), np.uint8)
        for r in parts.collect():  # at most 4,096 chunks, 32 MB a plane, in one job (an iterator takes a job for each partition)
            both = np.frombuffer(r["counts"], np.uint8).reshape(planes, -1)
            self.bits[:, r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = both
        return self


def holder(df: DataFrame, column: str, rows: int | None = None):
    """A broadcast Bloom filter (32 MB at most) of a column's xxhash64 values."""
    h = df.select(F.xxhash64(F.col(column)).alias("h"))
    return df.sparkSession.sparkContext.broadcast(Bits(df.count() if rows is None else rows).build(h, "h"))


def may_hold_raw(bits):
    """A function of a long column: whether the filter may hold the value itself."""

    @F.pandas_udf("boolean")
    def test(h):
        return h.__class__(bits.value.test(h.to_numpy(np.int64)) if len(h) else [], dtype=bool)

    return test


def may_hold(bits):
    """A function of a column: whether the filter may hold its xxhash64."""
    return lambda c: may_hold_raw(bits)(F.xxhash64(c))


def held_texts(batch: pa.RecordBatch, bits) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (id, text, h), only of rows whose hash h the broadcast filter may hold.

    Tested where the texts are used, so that a task needs one Python worker instead of two.
    """
    keep = pa.array(bits.value.test(np.asarray(batch.column(2), np.int64)), pa.bool_()) if len(batch) else pa.array([], pa.bool_())
    for b in slices(batch, "text"):
        yield b.filter(keep.slice(0, len(b)))
        keep = keep.slice(len(b))


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs whose text passes ``keep`` (texts -> booleans), each by itself, all columns kept; nothing shuffles."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # whatever signs the names have

    @trimmed
    def run(batches):
        for batch in batches:
            for b in slices(batch, f"c{at}"):
                yield b.filter(pa.array(keep(b.column(at)), pa.bool_()))

    ready(docs.sparkSession)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def one_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Of the rows of a key the one that comes first by ``order``, without the key; combined before the shuffle."""
    every = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(rows.columns) if c != key])
    names = [c for c in rows.columns if c != key]
    one = rows.groupBy(named(key)).agg(F.min_by(every, F.struct(*order)).alias("one"))
    return one.select(*[F.col(f"one.c{k + (k >= rows.columns.index(key))}").alias(c) for k, c in enumerate(names)])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
