"""Repeated substrings: interval expansion by backward extension, from anchors that equal strings must share.

Every 400-byte string has an anchor: the 32-byte gram of least hash in it (the first, of equals). Equal strings
have equal anchors at equal places, so only occurrences of one anchor are compared: 368 bytes to its left, 400
from it on. Rows of the Burrows-Wheeler order (contexts by what follows) are extended to the left one byte at a
time: the preceding byte is the transform, a stable sort by it is the LF step, and each step raises the common
prefixes of neighbours by one. A row whose common prefix reaches 400 starts a repeated string; rows that cannot
reach it any more are dropped.

An anchor with many contexts is split: strings that start up to half as far to its left share more bytes on its
right, those that start further share more on its left, so each half has longer anchors and smaller groups.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Bits, attach, holder, materialize, may_hold, may_hold_raw, mix, ready, slices, trimmed, utf8

LENGTH, GRAM = 400, 32
BACK = LENGTH - GRAM
#: An anchor with more distinct contexts than this is split.
CROWD = 20_000
_P = np.uint64(0xE7037ED1A0B428DB)
_TAB = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def rolling(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers, and the inverse powers: substring hashes in constant time."""
    n = len(buf)
    inv = pow(int(_P), -1, 1 << 64)
    steps = np.full((2, n + 1), 1, np.uint64)
    steps[0, 1:], steps[1, 1:] = _P, np.uint64(inv)
    up, down = np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TAB[buf] * up[:n], out=total[1:])
    return total, down


def substring(h: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total, down = h
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def window_first_min(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its least one by the upper 33 bits, the first of equals."""
    n = len(x) - w + 1
    pad = -len(x) % w
    key = (x >> np.uint64(31) << np.uint64(31)) | np.arange(len(x), dtype=np.uint64)
    y = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    right = np.minimum.accumulate(y, 1).ravel()
    left = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(left[:n], right[w - 1 : w - 1 + n]) & np.uint64((1 << 31) - 1)).astype(np.int64)


def _contexts(texts: pa.Array):
    """Of all texts: bytes, offsets, and for each anchor its text, place, bounds and hashes of gram and context."""
    buf, off = utf8(texts)
    if len(buf) < LENGTH:
        none = np.zeros(0, np.int64)
        return buf, off, none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = rolling(buf)
    at = np.arange(len(buf) - GRAM + 1)
    first = window_first_min(substring(h, at, at + GRAM), BACK + 1)
    inside = np.zeros(len(first) + 1, np.int64)  # windows that lie in one text
    size = np.diff(off)
    whole = size >= LENGTH
    np.add.at(inside, off[:-1][whole], 1)
    np.add.at(inside, (off[1:] - LENGTH + 1)[whole], -1)
    a = np.unique(first[np.cumsum(inside[:-1]) > 0])
    k = np.searchsorted(off, a, "right") - 1
    lo, hi = np.maximum(a - BACK, off[k]), np.minimum(a + LENGTH, off[k + 1])
    return buf, off, k, a, lo, hi, substring(h, a, a + GRAM), substring(h, lo, hi) ^ mix((a - lo).astype(np.uint64))


def extend(left: list[bytes], right: list[bytes], group: np.ndarray, back: int = BACK) -> np.ndarray:
    """Backward extension over contexts of several anchors: a (rows, back + 1) table of repeated starts.

    ``right`` has the bytes from the anchor on, of which a group shares 400 - ``back``, ``left`` up to ``back`` bytes
    before it; group numbers the anchors. Entry d of a row is true if the 400-byte string that starts d bytes left
    of the anchor is in another row of the group.
    """
    m = len(group)
    out, gram = np.zeros((m, back + 1), bool), LENGTH - back
    order = np.array(sorted(range(m), key=lambda i: (group[i], right[i])), np.int64)
    body = np.zeros((m, LENGTH), np.uint8)
    size = np.array([len(r) for r in right], np.int64)
    prior = np.zeros((m, back), np.uint8)
    room = np.array([len(x) for x in left], np.int64)
    for i in range(m):
        body[i, : size[i]] = np.frombuffer(right[i], np.uint8)
        prior[i, : room[i]] = np.frombuffer(left[i], np.uint8)[::-1]
    a, b = order[:-1], order[1:]
    lcp = np.zeros(m + 1, np.int64)
    if m > 1:
        differ = body[a] != body[b]
        common = np.where(differ.any(1), differ.argmax(1), LENGTH)
        lcp[1:m] = np.where(group[a] == group[b], np.minimum(common, np.minimum(size[a], size[b])), 0)
    rows = order
    for d in range(back + 1):
        best = np.maximum(lcp[:-1], lcp[1:])
        out[rows[best >= LENGTH], d] = True
        if d == back:
            break
        # every row left shares the anchor and all d bytes before it with a neighbour, or it can't start more
        live = np.flatnonzero((best >= gram + d) & (room[rows] > d))
        if not len(live):
            break
        cls = np.cumsum(lcp[:-1] < gram + d)[live]
        byte = prior[rows[live], d].astype(np.int64)
        turn = np.argsort(cls * 256 + byte, kind="stable")
        old, cls, byte = live[turn], cls[turn], byte[turn]
        same = (cls[1:] == cls[:-1]) & (byte[1:] == byte[:-1])
        nxt = np.zeros(len(old) + 1, np.int64)
        if same.any():
            p, q = old[:-1][same] + 1, old[1:][same] + 1
            low = np.minimum.reduceat(np.append(lcp, 0), np.stack([p, q], 1).ravel())[::2]
            nxt[1:-1][same] = low + 1
        rows, lcp = rows[old], nxt
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): 400-byte strings that start at bytes lo to hi of a text also start elsewhere."""

    @trimmed
    def occurrences(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                _, off, k, a, _, _, gram, ctx = _contexts(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(a - off[k]), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64))], ["row", "pos", "gram", "ctx"])

    @trimmed
    def spread(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                b = b.filter(pa.array(suspects.value.test(np.asarray(b.column(2), np.int64)) if len(b) else [], pa.bool_()))
                buf, _, _, a, lo, hi, gram, ctx = _contexts(b.column(1))
                hit = np.flatnonzero(several.value.test(gram.view(np.int64))) if len(gram) else np.zeros(0, np.int64)
                hit = hit[np.lexsort((ctx[hit], gram[hit]))]
                new = np.ones(len(hit), bool)
                new[1:] = (gram[hit[1:]] != gram[hit[:-1]]) | (ctx[hit[1:]] != ctx[hit[:-1]])
                hit, raw = hit[new], buf.tobytes()
                parts = [pa.array([raw[x:y] for x, y in zip(f[hit].tolist(), t[hit].tolist(), strict=True)], pa.binary()) for f, t in ((lo, a), (a, hi))]
                yield pa.RecordBatch.from_arrays([pa.array(gram[hit].view(np.int64)), pa.array(ctx[hit].view(np.int64)), *parts], ["gram", "ctx", "left", "right"])

    @trimmed
    def expand(batches):
        """Whole groups of one anchor, many at a time; partitions are sorted by anchor."""
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table):
            for back in np.unique(np.asarray(t["back"], np.int64)).tolist():
                own = t.filter(pc.equal(t["back"], back)).combine_chunks()
                _, group = np.unique(np.asarray(own["grp"], np.int64), return_inverse=True)
                marks = extend(own["left"].to_pylist(), own["right"].to_pylist(), group, back)
                marks &= np.asarray(own["lone"])[:, None]
                at, lo, hi = [], [], []
                for i in np.flatnonzero(marks.any(1)):
                    for x, y in _runs(marks[i]):
                        at.append(i), lo.append(x), hi.append(y)
                at = pa.array(at, pa.int64())
                gram, ctx, a = (own[c].combine_chunks().take(at) for c in ("gram", "ctx", "a"))
                yield pa.RecordBatch.from_arrays([gram, ctx, *(pc.add(a, pa.array(x, pa.int64())) for x in (lo, hi))], ["gram", "ctx", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            if t.num_rows >= 6000:
                g = np.asarray(t["grp"], np.int64)
                cut = int(np.searchsorted(g, g[-1], "left"))
                if cut:
                    yield from emit(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            if t.num_rows:
                yield from emit(t)

    @trimmed
    def split(batches):
        """Each context in two: strings that start up to back // 2 left of the anchor, and the others, anchored that much further left."""
        for b in batches:
            out = []
            for grp, gram, ctx, a, back, left, right in zip(*(col.to_pylist() for col in b.columns), strict=True):
                for lo, hi in ((0, back // 2), (back // 2 + 1, back)):
                    if lo > hi or len(left) < lo:
                        continue
                    r = (left[len(left) - lo :] + right)[:LENGTH]
                    share = LENGTH - (hi - lo)
                    if len(r) < share:
                        continue
                    before = left[max(0, len(left) - hi) : len(left) - lo]
                    g = _hash64(f"{grp}:{lo}:".encode() + r[:share])
                    out.append((g, _hash64(f"{g}:{len(before)}:".encode() + before + r), gram, ctx, a + lo, hi - lo, before, r))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[i : i + 2000], strict=True), [pa.int64()] * 6 + [pa.binary()] * 2, strict=True)], ["grp", "key", "gram", "ctx", "a", "back", "left", "right"])

    spark = ready(docs.sparkSession)
    text = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))
    occ = materialize(text.mapInArrow(occurrences, "row string, pos long, gram long, ctx long"), "anchors")
    total = occ.count()
    kinds = occ.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"))
    per = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("uses"))
    per = materialize(per.filter("uses > 1"), "grams")
    multi = per.filter("contexts > 1")
    several = holder_of(multi, "gram")
    # only texts that have such an anchor are looked at again
    suspects = holder(occ.filter(may_hold_raw(several)(F.col("gram"))).select("row").distinct(), "row")
    ctx = text.withColumn("h", F.xxhash64("row")).mapInArrow(spread, "gram long, ctx long, left binary, right binary")
    ctx = ctx.groupBy("gram", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    ctx = materialize(ctx, "contexts")
    rows = ctx.select(F.col("gram").alias("grp"), "gram", "ctx", F.lit(0).cast("long").alias("a"), F.lit(BACK).cast("long").alias("back"), "left", "right", F.lit(True).alias("lone"))
    big, found = materialize(multi.filter(F.col("contexts") > CROWD).select(F.col("gram").alias("grp")), "crowded"), []
    while True:
        crowded, some = may_hold(holder(big, "grp"))(F.col("grp")), not big.isEmpty()
        few = rows.filter(~crowded) if some else rows
        found.append(few.select("grp", "gram", "ctx", "a", "back", "left", "right", "lone").repartition("grp").sortWithinPartitions("grp").mapInArrow(expand, "gram long, ctx long, lo long, hi long"))
        if not some:
            break
        halves = rows.filter(crowded).select("grp", "gram", "ctx", "a", "back", "left", "right").mapInArrow(split, "grp long, key long, gram long, ctx long, a long, back long, left binary, right binary")
        halves = materialize(halves, "halves")
        # contexts alike over all that their half's strings cover stand for each other; all their strings repeat
        own = F.struct("gram", "ctx", "a", "back", "left", "right")
        kept = materialize(halves.groupBy("grp", "key").agg(F.first(own).alias("x"), F.count(F.lit(1)).alias("n")), "kept")
        again = attach(halves.select("grp", "key", "gram", "ctx", "a", "back"), kept.filter("n > 1").select("grp", "key", "n"), ["grp", "key"], "n", halves.count())
        found.append(again.select("gram", "ctx", F.col("a").alias("lo"), (F.col("a") + F.col("back")).alias("hi")))
        members = materialize(kept.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "members")
        rows = kept.filter(may_hold(holder(members, "grp"))(F.col("grp"))).select("grp", "x.*", (F.col("n") == 1).alias("lone"))
        big = members.filter(F.col("n") > CROWD).select("grp")
    # contexts that occur again whole: all their strings do
    whole = kinds.filter("n > 1").select("gram", "ctx", F.lit(0).cast("long").alias("lo"), F.lit(BACK).cast("long").alias("hi"))
    part = materialize(reduce(DataFrame.unionByName, found, whole), "starts")
    spans = part.groupBy("gram", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(spans.join(kinds, ["gram", "ctx"]), "spans")
    hit = occ.filter(may_hold(holder(spans, "ctx"))(F.col("ctx")))
    out = attach(hit, spans, ["gram", "ctx"], "n", total)
    return out.select("row", F.col("pos"), F.explode("spans").alias("s")).select("row", (F.col("pos") - F.col("s.hi")).alias("lo"), (F.col("pos") - F.col("s.lo")).alias("hi"))


def holder_of(df: DataFrame, column: str):
    """A filter that is tested with the column's own values."""
    return df.sparkSession.sparkContext.broadcast(Bits(df.count()).build(df, column))


def _hash64(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A byte goes if a 400-byte string over it also starts elsewhere, in any text or the same; strings never cross
    texts. Null counts as empty; shorter texts stay whole. Rows that repeat a doc_id are told apart by text, and
    equal rows lose the same bytes. An empty table gives no rows. Other columns are ignored.
    Texts without repeats pass straight through; only the others are joined with their spans.
    """

    @trimmed
    def cut(batches):
        for b in batches:
            kept, counts = [], np.zeros((3, len(b)), np.int64)
            for i, (t, spans) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                if spans and len(raw) >= LENGTH:
                    lo = np.clip(np.array([s["lo"] for s in spans]), 0, None)
                    hi = np.minimum(np.array([s["hi"] for s in spans]), len(raw) - LENGTH) + LENGTH
                    ok = hi - lo >= LENGTH
                    np.add.at(edge, lo[ok], 1)
                    np.add.at(edge, hi[ok], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(raw[~gone].tobytes())
                counts[:, i] = len(raw), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    ready(docs.sparkSession)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a row is named by id and text, so equal rows share spans and repeated ids do not mix
    rows = rows.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text"))))
    spans = materialize(repeated_starts(rows), "repeats").groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(spans, "row_spans")
    tested = rows.withColumn("may", may_hold(holder(spans, "row"))(F.col("row")))
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")
    clear = tested.filter("not may").select("doc_id", "text", none.alias("spans"))
    rest = tested.filter("may").join(spans, "row", "left").select("doc_id", "text", "spans")
    return clear.unionByName(rest).mapInArrow(cut, kind)
