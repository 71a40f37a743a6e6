"""Jaccard join on word shingles with a token-group matrix.

1. Texts with equal shingle sets collapse to one representative each.
2. Grouping: MinHash bands put likely similar representatives in a bucket; each is verified against the nearest two
   of up to 16 pivots there. Connected representatives form a group.
3. Token-group matrix: each set sends its prefix (its tokens, rare ones first, up to the length at which
   two sets of Jaccard >= 0.75 must share two tokens) to the token; a token lists the groups whose union has it.
   A query and a group that share fewer than two such tokens cannot hold a link: the bound. At frequent tokens
   a query meets only groups with a member there whose size and parity sketch leave room for a link.
4. Only qualifying groups are opened. A member stays if the prefixes and two parity sketches leave room for a link,
   and is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Bits, attach, fresh, held_texts, holder, materialize, may_hold, mix, named, one_of_each, ready, slices, trimmed, utf8
from millrace.llm.textnum import distinct, shingle_hashes, word_hashes

WORDS, BANDS, ROWS, SHARED, FIRST = 5, 6, 2, 2, 16
#: 64-bit words of a set's parity sketch: each token flips one bit, so two sketches differ in no more bits than the sets in tokens.
PARITY = 4
#: Pivots of a bucket at most.
PIVOTS = 16
#: Groups of so many members at a frequent token are tested one by one; larger ones qualify there untested.
TESTED = 4
#: Tokens in so many texts count as frequent and come last in the order of prefixes.
FREQUENT = 8
#: For counting, tokens are cut to 40 bits and dealt by the first 12; only their order depends on it.
RANGE_BITS, REST_BITS = 12, 28
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
NONE = -(1 << 63)


def _sets(batch: pa.RecordBatch, column: str = "text"):
    text = batch.column(batch.schema.get_field_index(column))
    return distinct(*shingle_hashes(*word_hashes(*utf8(text)), WORDS))


def _least(n: int) -> int:
    """Tokens that a set of n shares with any set of Jaccard 0.75 or more, at least."""
    return -(-3 * n // 4)


def _parity(mixed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity sketches of the non-empty sets that start at first."""
    bit, word = np.uint64(1) << (mixed & np.uint64(63)), (mixed >> np.uint64(6)) % np.uint64(PARITY)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), first) for k in range(PARITY)], axis=1)


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: size, a 128-bit signature of the shingle set, MinHash bands, a parity sketch; and the tokens of each task, packed for counting."""

    def packed(held):
        """Sorted tokens of each range, as byte planes of their differences."""
        t = np.sort(np.concatenate(held))
        z, cuts = zstandard.ZstdCompressor(level=1), np.searchsorted(t, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(REST_BITS))
        rest = (t & np.uint64((1 << REST_BITS) - 1)).astype(np.uint32)
        full = np.flatnonzero(np.diff(cuts))
        blobs = [z.compress(np.ascontiguousarray(np.diff(rest[cuts[k] : cuts[k + 1]], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()) for k in full]
        none = [pa.nulls(len(full), pa.int64()) for _ in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(full), *none, *(pa.nulls(len(full), pa.list_(pa.int64())) for _ in range(2)), pa.array(blobs, pa.binary())], names)

    @trimmed
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for b in slices(batch, "text"):
                sets, at = _sets(b)
                n = np.diff(at)
                held.append(sets >> np.uint64(64 - RANGE_BITS - REST_BITS))
                size += len(sets)
                full = np.flatnonzero(n)
                first = at[:-1][full]
                a, c = mix(sets), mix(sets ^ np.uint64(0x5851F42D4C957F2D))
                sig = np.zeros((2, len(n)), np.uint64)
                band = np.zeros((len(n), BANDS), np.uint64)
                odd = np.zeros((len(n), PARITY), np.uint64)
                if len(full):
                    odd[full] = _parity(a, first)
                    sig[:, full] = np.add.reduceat(a, first), np.add.reduceat(c, first)
                    low = [np.minimum.reduceat(a * s, first) for s in _SEEDS]
                    for k in range(BANDS):
                        band[full, k] = mix(low[ROWS * k] + mix(low[ROWS * k + 1]) + np.uint64(k))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel())) for x in (band, odd)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), *lists, pa.nulls(len(n), pa.binary())], names)
                if size > 2_000_000:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    names = ["doc_id", "n", "sig1", "sig2", "bands", "odd", "counts"]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, bands array<long>, odd array<long>, counts binary")


def frequent(parts: DataFrame):
    """A broadcast filter (32 MB at most) of the tokens that FREQUENT texts or more have.

    Tokens that it takes for frequent by mistake only come later in the order, for all texts alike.
    """

    def count(arrays):
        u, n = np.unique(np.concatenate(arrays), return_counts=True)
        return u[n >= FREQUENT].astype(np.int64)

    @trimmed
    def merge(batches):
        now, arrays = None, []
        for b in batches:
            for k, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now and arrays:
                    yield pa.RecordBatch.from_arrays([pa.array(count(arrays) | now << REST_BITS)], ["t"])
                    arrays = []
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
                now = k
                arrays.append(np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64))
        if arrays:
            yield pa.RecordBatch.from_arrays([pa.array(count(arrays) | now << REST_BITS)], ["t"])

    hot = materialize(parts.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "t long"), "frequent")
    return hot.sparkSession.sparkContext.broadcast(Bits(hot.count()).build(hot, "t"))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have Jaccard >= 0.75.

    Sets are computed anew for the texts in pairs alone. An id in many pairs gets copies of its set, one for each
    256 of its pairs, so no task gathers all of them.
    """
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")

    @trimmed
    def sets(batches):
        for batch in batches:
            for b in held_texts(batch, wanted):
                s, at = _sets(b)
                raw = s.tobytes()
                blobs = pa.array([raw[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), blobs], ["id", "tokens"])

    @trimmed
    def meet(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                if 4 * len(u) >= 3 * len(v) and len(u):
                    both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                    if 100 * both >= 75 * (len(u) + len(v) - both):
                        keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    wanted = holder(ids, "id")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), "text").withColumn("h", F.xxhash64("id"))
    tokens = materialize(rows.mapInArrow(sets, "id long, tokens binary").join(ids, "id", "left_semi"), "sets")
    total = pairs.count()
    uses = materialize(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "uses")
    many = attach(pairs, uses, ["b"], "c", total)
    salts = F.ceil(F.col("c") / 256).cast("long")
    many = many.withColumn("salt", F.pmod(F.xxhash64("a"), salts))
    copies = tokens.join(uses, F.col("id") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("tokens").alias("right"))
    left = tokens.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    met = many.select("a", "b", "salt").join(copies, ["b", "salt"]).join(left, "a").select("a", "b", "left", "right")
    return met.mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links (a, b) reach, for each id in edges.

    Rounds of contraction: each node joins its neighbour of least hash; a star goes in two rounds, a path in a
    logarithmic number. Each round's parents are written, then chased; nothing is collected.
    """
    left = materialize(edges.filter("a <> b").distinct(), "edges")
    forest = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("p"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("p"))
        moved = materialize(near.filter(F.col("m") < own).select(F.col("a").alias("id"), F.col("m.p").alias("p")), "parents")
        forest = moved if forest is None else forest.union(moved)
        m1, m2 = (moved.select(F.col("id").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        left = left.join(m1, "a", "left").join(m2, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        left = materialize(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if forest is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    while True:
        up = forest.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        forest = materialize(forest.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("far")), "forest")
        if forest.filter("far").isEmpty():
            break
        forest = forest.select("id", "p")
    forest = forest.select("id", "p").union(forest.select(F.col("p").alias("id"), "p").distinct())
    least = forest.groupBy("p").agg(F.min("id").alias("root"))
    return materialize(forest.join(least, "p").select("id", "root"), "roots")


def candidates(prefixes: DataFrame) -> DataFrame:
    """Token-group matrix: (tok, grp, gsize, doc, n, odd) rows -> (q, g, hits) that share two tokens or more.

    Of two groups, the members of the smaller one query the larger one. A token of one group gives nothing.
    Rows of frequent tokens have the size n and the parity sketch odd of their set. There a query passes over groups
    of few members whose every member at the token is too far from it to link: such hits cannot be part of a link.
    """

    def able(n, odd, a, b):
        """Rows a x rows b: whether sizes and sketches leave room for a link."""
        far = sum(np.bitwise_count(odd[a, k][:, None] ^ odd[b, k]).astype(np.int64) for k in range(PARITY))
        x, y = n[a][:, None], n[b]
        return (7 * far <= x + y) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y))

    def columns(b):
        """The batch as arrays; n is 0 where a row has no sketch."""
        odd = b.column(5)
        words = np.zeros((len(b), PARITY), np.uint64)
        words[np.asarray(odd.is_valid())] = np.asarray(odd.flatten(), np.int64).view(np.uint64).reshape(-1, PARITY)
        return [*(np.asarray(c, np.int64) for c in b.columns[:4]), np.asarray(b.column(4).fill_null(0), np.int64), words]

    @trimmed
    def run(batches):
        held = None

        def emit(t):
            tok, grp, size, doc, n, odd = t
            first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, int)
            run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tok))))
            mixed = np.zeros(len(first), bool)
            if len(first):
                mixed = np.minimum.reduceat(grp, first) != np.maximum.reduceat(grp, first)
            pick = np.flatnonzero(mixed[run_of])
            bounds = np.flatnonzero(np.diff(run_of[pick])) + 1
            for rows in np.split(pick, bounds) if len(pick) else []:
                rows = rows[np.argsort(grp[rows], kind="stable")]
                gs, at, there = np.unique(grp[rows], return_index=True, return_counts=True)
                g_size = size[rows][at]
                for lo in range(0, len(rows), 1024):  # tiles of 256 K cells, so 4 MB of pairs at most
                    part = rows[lo : lo + 1024]
                    for glo in range(0, len(gs), 256):
                        g, gn = gs[glo : glo + 256], g_size[glo : glo + 256]
                        less = (size[part][:, None] < gn) | ((size[part][:, None] == gn) & (grp[part][:, None] < g))
                        if n[rows[0]]:
                            few, starts = there[glo : glo + 256], at[glo : glo + 256]
                            room = np.repeat((few > TESTED)[None], len(part), axis=0)
                            for k in range(TESTED):
                                some = np.flatnonzero((few > k) & (few <= TESTED))
                                room[:, some] |= able(n, odd, part, rows[starts[some] + k])
                            less &= room
                        i, j = np.nonzero(less)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(doc[part][i]), pa.array(g[j])], ["q", "g"])

        for b in batches:
            now = columns(b)
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)] if held else now
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            yield from emit([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held:
            yield from emit(held)

    rows = prefixes.repartition("tok").sortWithinPartitions("tok").select("tok", "grp", "gsize", "doc", "n", "odd")
    hits = rows.mapInArrow(run, "q long, g long").groupBy("q", "g").agg(F.count(F.lit(1)).alias("hits"))
    return hits.filter(F.col("hits") >= SHARED)


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two rows link if their sets of distinct 5-word shingles (A-Z lower-cased, cut at white space; the whole
    sequence if shorter) have Jaccard >= 0.75; component_id is the smallest doc_id reachable. Null, empty and
    blank texts have no shingles and stand alone. Rows that share a doc_id count as one node. A null doc_id
    counts as the smallest id. An empty table gives no rows; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    table = materialize(profiles(docs), "profiles")
    rows = table.filter("counts is null").select("doc_id", "n", "sig1", "sig2", "bands", "odd")
    total = rows.count()
    often = frequent(table.filter("counts is not null").select(F.col("doc_id").alias("range"), "counts"))
    same = rows.filter("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    reps = materialize(same, "reps")

    band = reps.select("rep", "n", "odd", F.explode("bands").alias("band"))
    counts = materialize(band.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "bands")
    member = materialize(attach(band, counts, ["band"], "c", total * BANDS).select("rep", "n", "odd", "band", "c"), "banded")
    # a set in large buckets of many bands stands in the middle of its likes, whatever its id: the first of these in
    # each of PIVOTS slots of a bucket is a pivot, and a set is verified against its nearest two by parity sketches
    score = member.groupBy("rep").agg(F.sum("c").alias("score"))
    slots = member.join(score, "rep").groupBy("band", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("slot")).agg(F.max(F.struct("score", "rep", "n", "odd")).alias("p"))
    pivots = slots.groupBy("band").agg(F.collect_list("p").alias("pivots"))
    pivots = materialize(pivots.join(counts, "band"), "pivots")
    met = attach(member.drop("c"), pivots, ["band"], "c", total * BANDS)
    far = " + ".join(f"bit_count(odd[{k}] ^ p.odd[{k}])" for k in range(PARITY))
    near = f"transform(filter(pivots, p -> p.rep <> rep and 7 * ({far}) <= n + p.n and 4 * least(n, p.n) >= 3 * greatest(n, p.n)), p -> struct({far} as far, p.rep as rep))"
    pairs = met.select(F.col("rep").alias("a"), F.explode(F.expr(f"slice(array_sort({near}), 1, 2)")).alias("p")).select("a", F.col("p.rep").alias("b")).distinct()
    links = verified(docs, materialize(pairs, "pairs"))
    linked = components(links)

    groups = reps.select("rep", "n", "odd").distinct().join(linked, F.col("rep") == F.col("id"), "left").select("rep", "n", "odd", F.coalesce("root", "rep").alias("grp"))
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("gsize"))
    groups = materialize(groups.join(sizes, F.col("grp") == F.col("root"), "left").select("rep", "n", "odd", "grp", F.coalesce("gsize", F.lit(1)).cast("long").alias("gsize")), "groups")

    wanted, grouped = holder(groups, "rep"), holder(linked, "id")

    @trimmed
    def prefix(batches):
        for batch in batches:
            for b in held_texts(batch, wanted):
                s, at = _sets(b)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                cls = often.value.test(s >> np.uint64(64 - RANGE_BITS - REST_BITS)).astype(np.int64)
                order = np.lexsort((s, cls, doc))
                size = np.minimum(n, n - -(-3 * n // 4) + SHARED)
                keep = np.arange(len(s)) - at[:-1][doc] < size[doc]
                rank = (cls << 56) | (s >> np.uint64(8)).astype(np.int64)
                last = np.zeros(len(n), np.int64)
                last[n > 0] = rank[order][(at[:-1] + size - 1)[n > 0]]
                mates = grouped.value.test(np.asarray(b.column(2), np.int64)) if len(b) else np.zeros(0, bool)
                rare = np.bincount(doc[keep & (cls[order] == 0)], minlength=len(n))
                some = rare < size  # sets with a frequent token in the prefix need a sketch there
                odd = np.zeros((0, PARITY), np.uint64)
                if some.any():
                    odd = _parity(mix(s[some[doc]]), np.cumsum(n[some]) - n[some])
                odds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]) * PARITY, pa.int32()), pa.array(odd.view(np.int64).ravel()), mask=pa.array(~some))
                toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(s[order][keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(last), pa.array(mates), toks, pa.array(rare, pa.int32()), pa.array(n, pa.int64()), odds], ["rep", "last", "mates", "toks", "rare", "n", "odd"])

    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("rep"), "text").withColumn("h", F.xxhash64("rep"))
    found = materialize(text.mapInArrow(prefix, "rep long, last long, mates boolean, toks array<long>, rare int, n long, odd array<long>").filter("size(toks) > 1"), "prefixes", "none")
    # a set that the filter of grouped ids clears is a group of its own: its tokens need no join
    sketch = ["toks", "rare", "n", "odd"]
    alone = found.filter("not mates").select(*sketch, F.col("rep").alias("grp"), F.lit(1).cast("long").alias("gsize"), "rep")
    matrix = alone.union(found.filter("mates").join(groups.select("rep", "grp", "gsize"), "rep").select(*sketch, "grp", "gsize", "rep"))
    matrix = matrix.select(F.posexplode("toks").alias("pos", "tok"), "rare", "n", "odd", "grp", "gsize", F.col("rep").alias("doc"))
    often_there = F.col("pos") >= F.col("rare")
    matrix = matrix.select("tok", "grp", "gsize", "doc", F.when(often_there, F.col("n")).alias("n"), F.when(often_there, F.col("odd")).alias("odd"))
    cand = materialize(candidates(matrix), "qualifying")
    # Of two prefixes the one that ends first has met all its partners in the other: the overlap is at most the
    # shared prefix tokens and the rest of that set. A link needs 3/7 of both sizes.
    size = groups.join(found.select("rep", "last"), "rep")
    own = size.select(F.col("rep").alias("q"), F.col("n").alias("qn"), F.col("odd").alias("qo"), F.col("last").alias("ql"), F.col("grp").alias("qg"))
    member = size.select(F.col("rep").alias("m"), F.col("n").alias("mn"), F.col("odd").alias("mo"), F.col("last").alias("ml"), F.col("grp").alias("g"), "gsize")
    rest = lambda n: f"(ceil(0.75D * {n}) - {SHARED})"
    bound = f"hits + case when ql < ml then {rest('qn')} when ml < ql then {rest('mn')} else greatest({rest('qn')}, {rest('mn')}) end"
    # Sets of Jaccard >= 0.75 differ in a seventh of both sizes at most, and their sketches in no more.
    differ = " + ".join(f"bit_count(qo[{k}] ^ mo[{k}])" for k in range(PARITY))
    able = f"7 * ({differ}) <= qn + mn and 4 * least(qn, mn) >= 3 * greatest(qn, mn) and q <> m and 7 * ({bound}) >= 3 * (qn + mn)"
    early = f"(gsize <= {2 * FIRST} or pmod(xxhash64(m), gsize) < {FIRST})"
    at = groups.select("rep", "grp")

    def opened(rows: DataFrame, test: str) -> DataFrame:
        met = rows.join(own, "q").join(member, "g").filter(f"{able} and {test}")
        links = verified(docs, materialize(met.select(F.col("q").alias("a"), F.col("m").alias("b")).distinct(), "opened"))
        return materialize(links.join(at.toDF("a", "ga"), "a").join(at.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct(), "across")

    # A query meets a few members of a large group first, by a hash; only pairs of groups that stay apart open in full.
    across = opened(cand, early)
    apart = cand.join(member.filter(f"gsize > {2 * FIRST}").select("g").distinct(), "g", "left_semi").join(own.select("q", "qg"), "q")
    apart = apart.join(across.toDF("qg", "g"), ["qg", "g"], "left_anti").select("q", "g", "hits")
    apart = materialize(apart, "apart")
    if not apart.isEmpty():
        across = across.union(opened(apart, f"not {early}"))
    roots = components(across)

    final = groups.join(roots, F.col("grp") == F.col("id"), "left").groupBy("rep").agg(F.min(F.coalesce("root", "grp")).alias("component_id"))
    named = reps.select("sig1", "sig2", "rep", "copies").join(final, "rep").select("sig1", "sig2", "copies", "component_id")
    out = attach(rows.filter("n > 0").select("doc_id", "n", "sig1", "sig2"), named, ["sig1", "sig2"], "copies", total)
    out = out.select("doc_id", "n", "component_id").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    back = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select(back("doc_id"), F.col("n").alias("n_shingles"), back("component_id"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each group of near_groups(), all columns kept: that of the smallest doc_id, null ids last.

    Rows are told apart by doc_id and text, so null and repeated ids are no matter; of rows equal in both (and with a
    word) one stays. Texts without words all stay. An empty table stays empty.
    Only rows of groups of two or more shuffle with their text, equal ones combined before.
    """
    spark = ready(docs.sparkSession)
    node, same, may = fresh(docs, "node", "same", "may")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    near = materialize(near_groups(docs.select(key.alias("doc_id"), "text")).filter("n_shingles > 0").select(F.col("doc_id").alias("node"), F.col("component_id").alias("part")), "near")
    several = near.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    nodes = near.distinct()
    members = materialize(attach(nodes, several, ["part"], "n", near.count()).select("node", "part").distinct(), "members")
    rows = docs.withColumn(node, key)
    rows = rows.withColumn(may, may_hold(holder(members, "node"))(F.col(node)) & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    id_ = F.col("doc_id").cast("long")
    keys = rows.filter(F.col(may)).select(F.col(node).alias("node"), id_.alias("id")).distinct().join(members, "node")
    first = keys.groupBy("part").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    stay = first.select(F.col("first.node").alias("node"))
    gone = materialize(members.join(stay, "node", "left_anti").select("node"), "gone")
    some = one_of_each(rows.filter(F.col(may)).drop(may).withColumn(same, F.col(node)), same, [F.lit(0)])
    some = some.join(gone.toDF(same), F.col(node) == F.col(same), "left_anti")
    every = list(map(named, docs.columns))
    return rows.filter(~F.col(may)).select(*every).unionByName(some.select(*every))
