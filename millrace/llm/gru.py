"""Language-model scores: a gated recurrent network over words, with counts of the whole training corpus.

Frequent words, the end mark and one class for all other words make the network's vocabulary; its softmax is
factored into classes of words by frequency. A word outside it has the probability of that class times its
smoothed share of the class's training count.

Texts are hashed once, into blocks: a dictionary of the block's words, and its texts as places in it. Counts are
summed by ranges of hashes, and each block gets back the counts of its own words, so a frequent word costs a row's
worth a block and not one a text. Training and scoring read the blocks.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, materialize, mix, ready, slices, trimmed, utf8
from millrace.llm.textnum import word_hashes

WIDTH, PER_CLASS, CLASSES = 16, 64, 32
HEAD = PER_CLASS * CLASSES - 1  # frequent words; one place is the end mark's
LOG10 = float(np.log(10))
#: Rounds of training: rows whose hash (30 bits) is below the first value and in no earlier round, lanes, rate.
ROUNDS = ((1 << 24, 64, 0.01), (1 << 26, 64, 0.01), (1 << 28, 256, 0.01), (1 << 30, 256, 0.01))
#: Bytes of text of a block; entries of a range of hashes on average; parts that weights are cut in to be averaged; words of a window of scoring.
BLOCK, RANGE, PARTS, SCORED = 16 << 20, 1 << 20, 16, 1 << 14


class GRU:
    """Ids 0..HEAD-1 are frequent words, HEAD the end mark (also the start), HEAD + 1 any other word.

    All weights are views of one vector, ``flat``.
    """

    SHAPES = {"emb": (HEAD + 2, WIDTH), "wx": (WIDTH, 3 * WIDTH), "b": (3 * WIDTH,), "u": (WIDTH, 3 * WIDTH), "wc": (WIDTH, CLASSES + 1), "bc": (CLASSES + 1,), "ww": (CLASSES, WIDTH, PER_CLASS), "bw": (CLASSES, PER_CLASS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, rare: int, flat: np.ndarray | None = None) -> None:
        order = np.argsort(words)
        self.words, self.ids = words[order], order
        self.end, self.rare = HEAD, HEAD + 1
        self.counts, self.ends, self.rare_count = counts, ends, rare
        self.flat = self._start() if flat is None else flat

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in cls.SHAPES.items():
            out[k] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    @property
    def p(self) -> dict[str, np.ndarray]:
        return self.views(self.flat)

    def _start(self) -> np.ndarray:
        rng = np.random.default_rng(7)
        flat = (rng.standard_normal(self.SIZE) * 0.1).astype(np.float32)
        p = self.views(flat)
        n = np.zeros(PER_CLASS * CLASSES)
        n[: len(self.counts)] = self.counts
        n[HEAD] = self.ends
        by = (n + 0.5).reshape(CLASSES, PER_CLASS)
        p["b"][:] = 0
        p["wc"] *= 0.1
        p["ww"] *= 0.1
        p["bc"][:] = np.log(np.append(by.sum(1), self.rare_count + 0.5))
        p["bc"] -= p["bc"].max()
        p["bw"][:] = np.log(by / by.max(1, keepdims=True))
        return flat

    def lookup(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.ids[at], self.rare)

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray, out: tuple) -> None:
        """One step of the unit: (z and r, n, u's part of n, new state) go to ``out``; gates are 0.5 + 0.5 tanh(x / 2)."""
        zr, n, un, new = out
        hu = h @ u
        np.add(x[:, : 2 * WIDTH], hu[:, : 2 * WIDTH], out=zr)
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        un[...] = hu[:, 2 * WIDTH :]
        np.multiply(zr[:, WIDTH:], un, out=n)
        n += x[:, 2 * WIDTH :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= zr[:, :WIDTH]
        new += n

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
        """Natural log-probabilities of targets y after states h (rare: of the class alone); with grad, d/dh too."""
        p = self.p
        cls = y // PER_CLASS  # that of rare is CLASSES
        e = h @ p["wc"]
        e += p["bc"]
        e -= e.max(1, keepdims=True)
        np.exp(e, out=e)
        total = e.sum(1)
        rows = np.arange(len(y))
        own = e[rows, cls] / total
        dh = None
        if grad is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grad["wc"] += h.T @ e
            grad["bc"] += e.sum(0)
            dh = e @ p["wc"].T
        head = np.flatnonzero(cls < CLASSES)
        head = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(cls[head], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = head[cuts[c] : cuts[c + 1]]
            if not len(at):
                continue
            state = h[at]
            q = state @ p["ww"][c]
            q += p["bw"][c]
            q -= q.max(1, keepdims=True)
            np.exp(q, out=q)
            total = q.sum(1)
            k, word = np.arange(len(at)), y[at] % PER_CLASS
            own[at] *= q[k, word] / total
            if grad is not None:
                q /= total[:, None]
                q[k, word] -= 1
                grad["ww"][c] += state.T @ q
                grad["bw"][c] += q.sum(0)
                dh[at] += q @ p["ww"][c].T
        return np.log(np.maximum(own, 1e-37)), dh

    def score(self, ids: np.ndarray, off: np.ndarray, lanes: int | None = None, window: int | None = None) -> np.ndarray:
        """Log-probabilities (natural) of whole texts with their end marks; state goes on from window to window.

        Texts are dealt to lanes, one after the other, so that lanes are about as long as the longest text. A
        window has about SCORED words, so that each class of words has many in one product.
        """
        n = np.diff(off) + 1
        if not len(n):
            return np.zeros(0)
        lanes = lanes or int(min(1024, max(1, -(-n.sum() // n.max()))))
        heap, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for d in np.argsort(-n, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            dealt[k].append(d)
            heapq.heappush(heap, (size + int(n[d]), k))
        size = np.array([n[x].sum() for x in dealt])
        turn = [k for k in np.argsort(-size, kind="stable").tolist() if size[k]]
        steps, lanes = int(size.max()), len(turn)
        window = window or max(16, min(steps, SCORED // lanes))
        size = size[turn]
        y = np.full((steps, lanes), self.end)
        who = np.zeros((steps, lanes), np.int64)
        begins: dict[int, list[int]] = defaultdict(list)
        for k, lane in enumerate(turn):
            at = 0
            for d in dealt[lane]:
                y[at : at + n[d] - 1, k] = ids[off[d] : off[d + 1]]
                who[at : at + n[d], k] = d
                begins[at].append(k)
                at += int(n[d])
        tab, u, total = self.p["emb"] @ self.p["wx"] + self.p["b"], self.p["u"], np.zeros(len(n))
        x = np.concatenate([np.full((1, lanes), self.end), y[:-1]])
        room = [np.empty((lanes, w * WIDTH), np.float32) for w in (2, 1, 1)]
        hs = np.zeros((window + 1, lanes, WIDTH), np.float32)
        for t0 in range(0, steps, window):
            stop = min(window, steps - t0)
            live = int(np.searchsorted(-size, -t0, "left"))  # sizes fall: those beyond t0
            xw = tab[x[t0 : t0 + stop, :live]]
            for t in range(stop):
                h = hs[t, :live]
                if begin := begins.get(t0 + t):
                    h = h.copy()  # the state before has still to give its output
                    h[begin] = 0
                self.step(xw[t], h, u, (*(r[:live] for r in room), hs[t + 1, :live]))
            inside = (np.arange(t0, t0 + stop)[:, None] < size[:live]).ravel()
            got, _ = self.output(hs[1 : stop + 1, :live].reshape(-1, WIDTH)[inside], y[t0 : t0 + stop, :live].ravel()[inside])
            total += np.bincount(who[t0 : t0 + stop, :live].ravel()[inside], got, len(n))
            hs[0] = hs[stop]
        return total

    def fit(self, ids: np.ndarray, lanes: int = 64, window: int = 16, rate: float = 0.004, state: dict | None = None) -> np.ndarray:
        """One pass of truncated backpropagation over a stream of ids, cut in ``lanes`` that run side by side.

        Returns the end of the stream that fills no lanes (its first id has been learned, the others not yet).
        ``state`` keeps the optimiser's averages from call to call.
        """
        span = (len(ids) - 1) // lanes
        if not span:
            return ids
        state = {} if state is None else state
        x = np.ascontiguousarray(ids[: span * lanes].reshape(lanes, span).T)
        y = np.ascontiguousarray(ids[1 : span * lanes + 1].reshape(lanes, span).T)
        m, v2 = (state.setdefault(k, np.zeros(self.SIZE, np.float32)) for k in ("m", "v2"))
        grads, room = np.zeros(self.SIZE, np.float32), np.zeros(self.SIZE, np.float32)
        g, p = self.views(grads), self.p
        hs, zr = np.zeros((window + 1, lanes, WIDTH), np.float32), np.empty((window, lanes, 2 * WIDTH), np.float32)
        n, un = np.empty((window, lanes, WIDTH), np.float32), np.empty((window, lanes, WIDTH), np.float32)
        da, du = (np.empty((window, lanes, 3 * WIDTH), np.float32) for _ in range(2))
        for i, t0 in enumerate(range(0, span, window), state.get("i", 0) + 1):
            xs, ys = x[t0 : t0 + window], y[t0 : t0 + window]
            last = len(xs)
            grads[:] = 0
            xw = (p["emb"] @ p["wx"] + p["b"])[xs]
            for t in range(last):
                self.step(xw[t], hs[t], p["u"], (zr[t], n[t], un[t], hs[t + 1]))
            _, dh = self.output(hs[1 : last + 1].reshape(-1, WIDTH), ys.ravel(), g)
            dh = dh.reshape(last, lanes, WIDTH)
            # parts of the gradient that need no state from later steps
            z, r = zr[:last, :, :WIDTH], zr[:last, :, WIDTH:]
            to_n = (1 - z) * (1 - n[:last] * n[:last])
            to_z = (hs[:last] - n[:last]) * z * (1 - z)
            to_r = un[:last] * r * (1 - r)
            ut = np.ascontiguousarray(p["u"].T)
            carry = np.zeros((lanes, WIDTH), np.float32)
            for t in range(last - 1, -1, -1):
                d = dh[t]
                d += carry
                dn, out = da[t, :, 2 * WIDTH :], da[t]
                np.multiply(d, to_n[t], out=dn)
                np.multiply(d, to_z[t], out=out[:, :WIDTH])
                np.multiply(dn, to_r[t], out=out[:, WIDTH : 2 * WIDTH])
                du[t, :, : 2 * WIDTH] = out[:, : 2 * WIDTH]
                np.multiply(dn, r[t], out=du[t, :, 2 * WIDTH :])
                carry = d * z[t]
                carry += du[t] @ ut
            flat = da[:last].reshape(-1, 3 * WIDTH)
            g["u"] += hs[:last].reshape(-1, WIDTH).T @ du[:last].reshape(-1, 3 * WIDTH)
            g["b"] += flat.sum(0)
            turn = np.argsort(xs.ravel().astype(np.int16), kind="stable")
            by = xs.ravel()[turn]
            cuts = np.flatnonzero(np.diff(by, prepend=-1))
            table = np.add.reduceat(flat[turn], cuts, 0)  # gradient of the input table, its rows that occur
            g["emb"][by[cuts]] = table @ p["wx"].T
            g["wx"] += p["emb"][by[cuts]].T @ table
            grads *= 1 / ys.size
            grads *= min(1.0, 1.0 / max(math.sqrt(float(grads @ grads)), 1e-9))
            m += 0.1 * (grads - m)
            grads *= grads
            grads -= v2
            grads *= 0.01
            v2 += grads
            np.multiply(v2, 1 / (1 - 0.99**i), out=room)
            np.sqrt(room, out=room)
            room += 1e-7
            np.divide(m, room, out=room)
            room *= rate / (1 - 0.9**i)
            self.flat -= room
            hs[0] = hs[last]
        state["i"] = i
        return ids[span * lanes :]


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    top = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return zstandard.ZstdCompressor(level=1).compress(raw[:top].tobytes())


def expand(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = raw.reshape(-1, n).T
    return out.view("<u8").ravel()


def numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes and the place of each word among them; only the distinct ones are sorted."""
    found = pa.array(words).dictionary_encode()
    u = np.asarray(found.dictionary)
    order = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[np.asarray(found.indices)]


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows of BLOCK bytes of text or more: ids and sizes of the texts, the sorted word hashes, their training counts, the texts as places among them."""

    @trimmed
    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, learn = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            sizes, words = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            u, inv = numbered(words)
            teach = np.asarray(learn).astype(bool)
            counts = np.bincount(inv, np.repeat(teach, sizes), len(u)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, learn, pa.array(sizes, pa.int32()))]
            blobs = [pa.array([x], pa.binary()) for x in (u.tobytes(), squeeze(counts), squeeze(inv))]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), *lists, *blobs, pa.array([len(u)]), pa.array([int(teach.sum())])], ["block", "doc_id", "learn", "size", "words", "counts", "stream", "kinds", "ends"])

        for batch in batches:
            for b in slices(batch, "text"):
                h, wo = word_hashes(*utf8(b.column(2)))
                held.append((b.column(0), b.column(1), np.diff(wo), h))
                size += b.column(2).nbytes
                if size >= BLOCK:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    kind = "block long, doc_id array<long>, learn array<boolean>, size array<int>, words binary, counts binary, stream binary, kinds long, ends long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(7) != 2, F.lit(False)).alias("learn"), "text").mapInArrow(run, kind)


def range_bits(entries: int) -> int:
    return max(6, math.ceil(math.log2(max(1, entries / RANGE))))


def corpus_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """For each block and range of hashes the training counts, over all blocks, of the block's words there.

    Rows without a block sum up a range: its words with a count, their counts, and its HEAD most frequent words.
    There are 2**bits ranges, more for more entries of all dictionaries, so a task holds about RANGE of them at a time.
    """
    names = ["range", "block", "totals", "kinds", "learned", "top_h", "top_c"]

    @trimmed
    def cut(batches):
        for b in batches:
            for block, words, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                h = np.frombuffer(words, np.uint64)
                c = expand(counts, len(h))
                edges = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                edges = np.append(edges, len(h))
                full = np.flatnonzero(np.diff(edges))
                at = [(edges[k], edges[k + 1]) for k in full.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), block)), pa.array([h[x:y].tobytes() for x, y in at], pa.binary()), pa.array([squeeze(c[x:y]) for x, y in at], pa.binary())], ["range", "block", "h", "c"])

    @trimmed
    def merge(batches):
        now, held = None, []

        def emit():
            blocks, hs, cs = zip(*held, strict=True)
            u, inv = numbered(np.concatenate(hs))
            total = np.bincount(inv, np.concatenate(cs), len(u)).astype(np.int64)
            mine = np.split(total[inv], np.cumsum([len(h) for h in hs])[:-1])
            top = np.flatnonzero(total)
            top = top[np.lexsort((u[top].view(np.int64), -total[top]))[:HEAD]]
            n = len(blocks)
            lists = [pa.array([None] * n + [x.tolist()], pa.list_(pa.int64())) for x in (u[top].view(np.int64), total[top])]
            sums = [pa.array([None] * n + [x], pa.int64()) for x in (int((total > 0).sum()), int(total.sum()))]
            return pa.RecordBatch.from_arrays([pa.array([now] * (n + 1), pa.int64()), pa.array([*blocks, None], pa.int64()), pa.array([*map(squeeze, mine), None], pa.binary()), *sums, *lists], names)

        for b in batches:
            for k, block, h, c in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
                if k != now and held:
                    yield emit()
                    held = []
                now = k
                h = np.frombuffer(h, np.uint64)
                held.append((block, h, expand(c, len(h))))
        if held:
            yield emit()

    rows = blocks.filter("kinds > 0").select("block", "words", "counts").mapInArrow(cut, "range long, block long, h binary, c binary")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "range long, block long, totals binary, kinds long, learned long, top_h array<long>, top_c array<long>")


def averaged(weights: DataFrame, parts: int) -> tuple[int, np.ndarray | None]:
    """Ids learned from, and the mean weights, by those ids: summed on executors in two steps, so no task reads more than about sqrt(parts) copies of a part."""

    @trimmed
    def add(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            for chunk, grp, n, v in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = held.setdefault((chunk, grp), [0, 0.0])
                x[0] += n
                x[1] = x[1] + np.frombuffer(v, np.float64)
        out = [(*k, n, v.tobytes()) for k, (n, v) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["chunk", "grp", "n", "v"])

    kind = "chunk long, grp long, n long, v binary"
    first = weights.withColumn("grp", F.pmod("grp", F.lit(max(1, math.isqrt(parts))))).repartition("chunk", "grp").mapInArrow(add, kind)
    rows = first.withColumn("grp", F.lit(0).cast("long")).repartition("chunk").mapInArrow(add, kind).orderBy("chunk").collect()
    return (rows[0]["n"], np.concatenate([np.frombuffer(r["v"], np.float64) for r in rows]) / rows[0]["n"]) if rows else (0, None)


def train(blocks: DataFrame, model: GRU) -> None:
    """Fit the network on the whole texts of all training rows of the blocks, each row once.

    A hash of doc_id deals the rows to ROUNDS of growing size. In a round each input partition trains a copy of
    the network on its rows; the copies are averaged by the ids they learned from and start the next round.
    ``model.learned`` counts those ids.
    """
    spark = ready(blocks.sparkSession)
    model.learned, below = 0, 0
    rows = blocks.filter("ends > 0").select("doc_id", "learn", "size", "words", "stream")
    for top, lanes, rate in ROUNDS:
        shared = spark.sparkContext.broadcast(model)

        @trimmed
        def run(batches, shared=shared, below=below, top=top, lanes=lanes, rate=rate):
            m = shared.value
            m.flat = m.flat.copy()
            done, rest, state = 0, np.array([m.end]), {}
            for b in batches:
                for ids, learn, size, words, stream in zip(*b.columns, strict=True):
                    own = np.asarray(learn.values).astype(bool)
                    deal = mix(np.asarray(ids.values.fill_null(0), np.int64).view(np.uint64)) >> np.uint64(34)
                    own &= (deal >= np.uint64(below)) & (deal < np.uint64(top))
                    if not own.any():
                        continue
                    size = np.asarray(size.values, np.int64)
                    word = m.lookup(np.frombuffer(words.as_py(), np.uint64))
                    text = word[expand(stream.as_py(), int(size.sum())).astype(np.int64)[np.repeat(own, size)]] if len(word) else np.zeros(0, np.int64)
                    text = np.insert(text, np.cumsum(size[own]), m.end)
                    done += len(text)
                    rest = m.fit(np.concatenate([rest, text]), lanes, rate=rate, state=state)
            for few in (8, 1):  # what fills no lanes
                rest = m.fit(rest, few, rate=rate, state=state)
            if done:
                parts = np.array_split(m.flat.astype(np.float64) * done, PARTS)
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array([part] * PARTS, pa.int64()), pa.array([done] * PARTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "grp", "n", "v"])

        each = materialize(rows.mapInArrow(run, "chunk long, grp long, n long, v binary"), "weights")
        n, mean = averaged(each, blocks.rdd.getNumPartitions())
        if n:
            model.flat = mean.astype(np.float32)
            model.learned += n
        shared.unpersist()
        below = top


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and network learn from all rows whose crc32(doc_id) mod 7 is not 2 (rows without doc_id train nothing). Null and empty texts
    have one token, the end. With no training row every count is zero. Each repeated row is scored; an empty
    table gives no rows; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    blocks = materialize(blocks_of(docs), "blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "ends")]).first()
    bits = range_bits(sums["kinds"])
    totals = materialize(corpus_counts(blocks, bits), "totals")
    known = totals.filter("block is null")
    stat = known.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "learned")]).first()
    head = known.select(F.explode(F.arrays_zip("top_h", "top_c")).alias("x")).select("x.*").orderBy(F.desc("top_c"), "top_h").limit(HEAD).collect()
    n = np.array([r["top_c"] for r in head], np.int64)
    ends = sums["ends"]
    tokens, kinds = stat["learned"] + ends, stat["kinds"] + (ends > 0)
    model = GRU(np.array([r["top_h"] for r in head], np.int64).view(np.uint64), n, ends, stat["learned"] - int(n.sum()))
    train(blocks, model)
    floor = float(np.log10(tokens + kinds + 1))
    others = float(np.log10(model.rare_count + stat["kinds"] - len(head) + 1))  # words outside the network, all unseen ones as one
    end_score = float(np.log10(ends + 1))
    shared = spark.sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        m = shared.value
        for b in batches:
            for ids, size, words, stream, parts in zip(*b.columns, strict=True):
                size = np.asarray(size.values, np.int64)
                off = np.concatenate([[0], np.cumsum(size)])
                h = np.frombuffer(words.as_py(), np.uint64)
                at = expand(stream.as_py(), int(off[-1])).astype(np.int64)
                # ranges are in the order of the dictionary
                count, part = [np.zeros(0)], 0
                for x in parts.as_py() or []:
                    edge = int(np.searchsorted(h >> np.uint64(64 - bits), np.uint64(x["range"]), "right"))
                    count.append(expand(x["totals"], edge - part))
                    part = edge
                count = np.concatenate(count)
                word, log = m.lookup(h), np.log10(count + 1.0)
                doc = np.repeat(np.arange(len(size)), size)
                each = lambda x: np.bincount(doc, x[at], len(size))
                score = m.score(word[at] if len(h) else at, off) / LOG10 + each(np.where(word == m.rare, log - others, 0.0))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(size + 1), pa.array(each(count > 0).astype(np.int64) + int(ends > 0)), pa.array(each(log) + end_score - (size + 1) * floor), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    of = totals.filter("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "totals"))).alias("parts"))
    found = blocks.select("block", "doc_id", "size", "words", "stream").join(of, "block", "left").select("doc_id", "size", "words", "stream", "parts")
    found = found.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (F.coalesce(fold(7), F.lit(-1)) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
