"""Toxicity of texts whose words may be disguised: a noisy channel is undone first, then words are scored."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, materialize, ready, slices, trimmed, union

#: Letters that a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
_EDGE = " \t\"'.,;:!?()[]{}<>%&#*"
#: The same without the signs of LEET: what is trimmed before the channel.
_OUTER = "".join(c for c in _EDGE if c not in LEET)
#: Letters of the stems that stand in the lexicon beside whole words, as ``abcde-``: longest first.
STEMS = (7, 6, 5)
#: Marks of documents that are sent to the texts at once; each further lot reads the table once more.
MARKS = 2_000_000
_TWICE = "(" + "|".join(2 * chr(c) for c in range(97, 123)) + ")"
_ODD = r"\pL[^\pL]+\pL|\pL[0-9@$!|+€]|[0-9@$!|+€]\pL|(aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz)|(ii|uu|aa)"


class Channel:
    """Viterbi decoding of a token's character lattice under a character trigram model."""

    KEEP, SWAP, DROP, REPEAT, LOSE = 0.0, math.log(0.6), 0.0, math.log(0.2), math.log(0.02)

    def __init__(self, tri: dict[str, float]) -> None:
        bi: dict[str, float] = defaultdict(float)
        one: dict[str, float] = defaultdict(float)
        ctx2: dict[str, float] = defaultdict(float)
        ctx1: dict[str, float] = defaultdict(float)
        for k, n in tri.items():
            bi[k[1:]] += n
            one[k[2]] += n
            ctx2[k[:2]] += n
            ctx1[k[1]] += n
        self.tri, self.bi, self.one = tri, dict(bi), dict(one)
        self.ctx2, self.ctx1, self.total = dict(ctx2), dict(ctx1), sum(one.values()) + 1
        self.memo: dict[str, float] = {}

    def logp(self, ctx: str, c: str) -> float:
        k = ctx + c
        if k not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            p1 = (self.one.get(c, 0) + 0.01) / self.total
            p2 = (self.bi.get(k[1:], 0) + 5 * p1) / (self.ctx1.get(ctx[1], 0) + 5)
            self.memo[k] = math.log((self.tri.get(k, 0) + 2 * p2) / (self.ctx2.get(ctx, 0) + 2))
        return self.memo[k]

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token, whatever its length; '' for a token without any."""
        beam: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        last = ""
        for ch in token:
            if ch.isalpha():
                options = [(ch, self.KEEP)] + ([("", self.REPEAT)] if ch == last else [])
            elif ch in LEET:
                options = [(x, self.SWAP) for x in LEET[ch]] + [("", self.LOSE)]
            else:
                options = [("", self.DROP)]
            new: dict[str, tuple[float, tuple | None]] = {}
            for ctx, (score, path) in beam.items():
                for c, cost in options:
                    s = score + cost + (self.logp(ctx, c) if c else -1.0 if ch.isalpha() else 0.0)
                    to = (ctx + c)[-2:] if c else ctx
                    if to not in new or new[to][0] < s:
                        new[to] = (s, (c, path) if c else path)
            beam, last = new, ch
        _, path = max((s + self.logp(ctx, "$"), p or ()) for ctx, (s, p) in beam.items())
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


def trigrams(words: dict[str, float]) -> dict[str, float]:
    """Counts of the character trigrams of weighted words, two signs before a word and one after it."""
    out: dict[str, float] = defaultdict(float)
    for w, n in words.items():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return dict(out)


def plain(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), _EDGE)


def word_table(texts: pa.Array):
    """Distinct words of some texts, each word's number, and where each text's words begin."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    enc = split.flatten().dictionary_encode()
    return enc.dictionary, np.asarray(enc.indices, np.int64), np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()


def stems(words: pa.Array) -> list[pa.Array]:
    """For each length of STEMS the stem of each word that is longer, or null."""
    n = pc.utf8_length(words)
    return [pc.if_else(pc.greater(n, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "-", ""), pa.scalar(None, pa.string())) for k in STEMS]


def tally(texts: pa.Array, y: np.ndarray) -> pa.Table:
    """(w, n1, n0): in how many texts marked 1 and 0 each word stands, stems beside words."""
    words, code, wo = word_table(texts)
    if not len(words):
        return pa.table({"w": pa.array([], pa.string()), "n1": pa.array([], pa.int64()), "n0": pa.array([], pa.int64())})
    bare = plain(words)
    every = pa.concat_arrays([x.cast(pa.string()) for x in (bare, *stems(bare))]).dictionary_encode()
    number = np.asarray(pc.fill_null(every.indices, -1), np.int64).reshape(-1, len(words))
    pair = np.unique(np.repeat(np.arange(len(wo) - 1), np.diff(wo)) * len(words) + code)
    text, most = pair // len(words), len(every.dictionary)
    own = [(text * most + n)[n >= 0] for n in (row[pair % len(words)] for row in number)]
    text, entry = np.divmod(np.unique(np.concatenate(own)), most)
    n1 = np.bincount(entry, y[text], most).astype(np.int64)
    return pa.table({"w": every.dictionary, "n1": n1, "n0": np.bincount(entry, minlength=most) - n1})


class Scorer:
    """Hits of a lexicon of restored words, and a logistic model over them."""

    def __init__(self, lexicon: list[str], channel: Channel, weights: np.ndarray | None = None, bias: float = -3.0, known: list[str] | None = None) -> None:
        self.lexicon, self.channel, self.bias = lexicon, channel, bias
        self.weights = np.zeros(len(lexicon)) if weights is None else weights
        self.known = known or []  # words with double letters that are no disguise
        self.at = {w: i for i, w in enumerate(lexicon)}
        self.inside = re.compile("|".join(sorted((re.escape(w.removesuffix("-")) for w in lexicon if len(w) > 2), key=len, reverse=True)) or r"(?!)")
        self.memo: dict[str, int] = {}

    def restore(self, word: str) -> int:
        """Lexicon number of a disguised word, or -1."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            whole = self.channel.decode(word)
            tries = [whole, *(whole[:k] + "-" for k in STEMS if len(whole) > k)]
            self.memo[word] = next((self.at[t] for t in tries if t in self.at), -1)
        return self.memo[word]

    def hits(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each text how often each lexicon word occurs, plain or restored."""
        words, code, wo = word_table(texts)
        if not len(words):
            return [{} for _ in range(len(wo) - 1)]
        bare = plain(words)
        entries = pa.array(self.lexicon, pa.string())
        number = np.asarray(pc.fill_null(pc.index_in(bare, entries), -1), np.int64).copy()
        for stem in stems(bare):
            at = np.asarray(pc.fill_null(pc.if_else(pc.is_valid(stem), pc.index_in(stem, entries), -1), -1), np.int64)
            number = np.where(number < 0, at, number)
        signed = pc.utf8_trim(pc.utf8_lower(words), _OUTER)  # an outer sign may stand for a letter
        twice = np.asarray(pc.match_substring_regex(bare, _TWICE), bool) & ~np.asarray(pc.is_in(bare, pa.array(self.known, pa.string())), bool)
        odd = (np.asarray(pc.match_substring_regex(bare, _ODD), bool) | twice) & (number < 0)
        for i in np.flatnonzero(odd):
            number[i] = self.restore(bare[i].as_py())
        outer = np.asarray(pc.not_equal(signed, bare), bool) & np.asarray(pc.greater(pc.utf8_length(bare), 1), bool) & (number < 0)
        for i in np.flatnonzero(outer):
            number[i] = self.restore(signed[i].as_py())
        out: list[Counter] = [Counter() for _ in range(len(wo) - 1)]
        seen = number[code]
        at = np.flatnonzero(seen >= 0)
        for d, n in zip((np.searchsorted(wo, at, "right") - 1).tolist(), seen[at].tolist(), strict=True):
            out[d][n] += 1
        # letters with spaces between them: runs of three or more one-letter words
        bare = pc.if_else(pc.equal(pc.utf8_length(bare), 1), bare, signed)  # a lone sign stays
        single = np.asarray(pc.equal(pc.utf8_length(bare), 1), bool)[code]
        if single.any():
            edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                if b - a < 3:
                    continue
                cuts = [a, *wo[np.searchsorted(wo, a, "right") : np.searchsorted(wo, b, "left")].tolist(), b]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if y - x >= 3:
                        whole = self.channel.decode("".join(bare.take(pa.array(code[x:y])).to_pylist()))
                        d = int(np.searchsorted(wo, x, "right")) - 1
                        for w in self.inside.findall(whole):
                            out[d][self.at[w] if w in self.at else self.at[w + "-"]] += 1
        return out

    def score(self, hits: list[dict[int, int]]) -> list[float]:
        out = []
        for h in hits:
            z = self.bias + sum(self.weights[k] * (1 + math.log(n)) for k, n in h.items())
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit(rows: DataFrame, size: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on 1 + log(count) of the entries that a text has, over all rows (y, k, n).

    Each round is one pass over the rows on the executors, which send sums alone. Quasi-Newton steps (the last ten
    differences, scaled by each entry's own curvature) under a normal prior of variance 10, until the gradient is gone.
    """

    def sums(w: np.ndarray, curve: bool = False) -> tuple[float, np.ndarray]:
        """Loss and gradient, or instead of the gradient its diagonal derivative; the last place is the bias."""
        shared = rows.sparkSession.sparkContext.broadcast(w)

        @trimmed
        def part(batches):
            loss, out, w = 0.0, np.zeros(size + 1), shared.value
            for b in batches:
                y, k, n = np.asarray(b.column(0), np.float64), b.column(1), b.column(2)
                col = np.asarray(k.flatten(), np.int64)
                row = np.repeat(np.arange(len(y)), np.diff(np.asarray(k.offsets, np.int64)))
                x = 1 + np.log(np.asarray(n.flatten(), np.float64))
                z = np.clip(np.bincount(row, x * w[col], len(y)) + w[-1], -30, 30)
                p = 1 / (1 + np.exp(-z))
                e = p * (1 - p) if curve else p - y
                loss += float((np.log1p(np.exp(z)) - y * z).sum())
                out[:-1] += np.bincount(col, (x * x if curve else x) * e[row], size)
                out[-1] += e.sum()
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (loss, at.astype("<i4").tobytes(), out[at].tobytes())], ["loss", "at", "sums"])

        total, out = 0.0, np.zeros(size + 1)
        for r in sorted(rows.mapInArrow(part, "loss double, at binary, sums binary").collect()):
            total += r["loss"]
            out[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["sums"], np.float64)
        shared.destroy()
        return total, out

    marks = rows.agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    prior = np.append(np.full(size, 0.1), 0.0)
    w = np.zeros(size + 1)
    p = min(max(marks["y"] or 0.0, 1e-3), 1 - 1e-3)
    w[-1] = math.log(p / (1 - p))
    scale = 1 / np.sqrt(sums(w, curve=True)[1] + prior + 1e-9)

    def at(u: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = sums(u * scale)
        return loss + float((prior * (u * scale) ** 2).sum()) / 2, (g + prior * u * scale) * scale

    u = w / scale
    loss, g = at(u)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= 1e-4 * math.sqrt(marks["n"]):
            break
        step, turns = -g, []
        for s, d in reversed(kept):
            turns.append((s @ step) / (s @ d))
            step = step - turns[-1] * d
        if kept:
            step = step * ((kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]))
        for (s, d), t in zip(kept, reversed(turns), strict=True):
            step = step + (t - (d @ step) / (s @ d)) * s
        length = 1.0
        while length > 1e-6:
            to, slope = at(u + length * step), float(g @ step)
            if to[0] <= loss + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        s, d = length * step, to[1] - g
        if s @ d > 1e-12:
            kept = [*kept[-9:], (s, d)]
        u, (loss, g) = u + s, to
    w = u * scale
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on all labelled rows. The marks go to the texts, MARKS of them at a time, so that no text is shuffled.

    The lexicon has the words, and stems of words, that mark toxic documents beyond chance (a likelihood ratio over
    1e4); a word counts for itself or else for its longest stem. The character model learns from all words, each
    weighing the logarithm of its texts, and, more, from the lexicon. What reaches the driver follows the lexicon
    and the number of distinct trigrams, not the rows.
    """
    spark = ready(docs.sparkSession)
    kinds = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    kinds = materialize(kinds, "marks")
    parts = max(1, -(-kinds.count() // MARKS))
    own = [kinds.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k) for k in range(parts)]
    rows = materialize(union([docs.select("doc_id", "text").join(F.broadcast(k), "doc_id").select("y", "text") for k in own]), "labelled")

    @trimmed
    def count(batches):
        held, docs_of = [], [0, 0]

        def whole() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).group_by("w").aggregate([("n1", "sum"), ("n0", "sum")])
            held.clear()
            yield from t.select(["w", "n1_sum", "n0_sum"]).rename_columns(["w", "n1", "n0"]).combine_chunks().to_batches(20_000)

        for batch in batches:
            for b in slices(batch, "text"):
                y = np.asarray(b.column(0), np.int64)
                held.append(tally(b.column(1), y))
                docs_of = [docs_of[0] + int((y == 0).sum()), docs_of[1] + int((y == 1).sum())]
                if sum(map(len, held)) > 1 << 18:
                    yield from whole()
        held.append(pa.table({"w": pa.array([None], pa.string()), "n1": [docs_of[1]], "n0": [docs_of[0]]}))
        yield from whole()

    table = materialize(rows.mapInArrow(count, "w string, n1 long, n0 long").groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "words")
    docs_of = table.filter("w is null").first()
    if docs_of is None or not docs_of["n1"]:
        return Scorer([], Channel({}))
    base = docs_of["n1"] / (docs_of["n1"] + docs_of["n0"])
    part = F.col("n1") / (F.col("n1") + F.col("n0"))
    gain = F.col("n1") * F.log(part / base) + F.col("n0") * F.when(F.col("n0") > 0, F.log((1 - part) / (1 - base))).otherwise(0)
    marks = table.filter("w is not null and length(w) > 1").filter(part > base).filter(gain > math.log(1e4))
    lex = [r["w"] for r in marks.orderBy(gain.desc(), "w").collect()]

    @trimmed
    def letters(batches):
        own: Counter = Counter()
        for b in batches:
            own.update(trigrams(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))))
            if len(own) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["g", "n"])
                own.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["g", "n"])

    common = table.filter("w is not null").filter(F.col("w").rlike(r"^\p{L}+$")).select("w", F.log1p(F.col("n1") + F.col("n0")).alias("n"))
    top = common.agg(F.max("n")).first()[0] or math.log(2)
    # whole thousandths, so that sums don't depend on their order
    grams = common.select("w", F.round(1000 * F.col("n")).cast("long").alias("n")).mapInArrow(letters, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    tri = Counter({r["g"]: r["n"] / 1000 for r in grams.orderBy("g").collect()})
    tri.update(trigrams({w: 20 * top for w in lex if w.isalpha()}))
    scorer = Scorer(lex, Channel(dict(tri)))
    shared = spark.sparkContext.broadcast(scorer)

    @trimmed
    def mistaken(batches):
        """Of words with double letters those that would be taken for an entry in disguise."""
        for b in batches:
            yield b.filter(pa.array([shared.value.restore(w) >= 0 for w in b.column(0).to_pylist()], pa.bool_()))

    twice = table.filter("n0 >= 5").filter(F.col("w").rlike(_TWICE)).select("w")
    scorer.known = sorted(r["w"] for r in twice.mapInArrow(mistaken, "w string").collect())
    exact = spark.sparkContext.broadcast(scorer)

    @trimmed
    def measure(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                hits = exact.value.hits(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(int, h)) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int32()))], ["y", "k", "n"])

    found = materialize(rows.mapInArrow(measure, "y int, k array<int>, n array<int>"), "hits")
    scorer.weights, scorer.bias = fit(found, len(lex))
    return scorer


def toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and score; null and empty texts get the score of no hits.

    Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(scorer)

    @trimmed
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(shared.value.hits(b.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def predict_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Learn from labels outside fold 2 of 4, score every row.

    Labels without doc_id or mark teach nothing; of labels that repeat a doc_id the toxic one counts. Rows without
    doc_id are not held out; nulls, repeats and empty tables as in toxicity(). Without toxic labels every score is alike.
    """
    scored = toxicity(docs, train(docs, labels.filter(fold(4) != 2)))
    return scored.select("doc_id", (F.coalesce(fold(4), F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
