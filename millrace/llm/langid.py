"""Language mixtures: expectation-maximisation over byte n-gram likelihoods, set chosen by penalised likelihood."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fold, kept_rows, ready, slices, trimmed, utf8

BUCKETS = 1 << 14
UNKNOWN = "und"
_CLASS = np.zeros(256, np.uint32)  # letters keep a value of their own, all else is a gap
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams of a text with at least one letter in them; runs of other bytes count as one gap."""
    c = _CLASS[raw]
    keep = c > 0
    keep[1:] |= c[:-1] > 0
    c = np.concatenate([[0], c[keep], [0]]).astype(np.uint32)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    g = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
    g = g[c[1:-1] > 0]
    return (g * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64)


class Mixture:
    """Log-likelihoods of n-grams by language, and one for noise (all n-grams alike)."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.1, penalty: float = 4.0) -> None:
        self.langs, self.penalty = langs, penalty
        p = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)
        self.p = np.ascontiguousarray(np.vstack([p, np.full((1, BUCKETS), 1 / BUCKETS)]).T, np.float64)
        self.log = np.log(self.p)

    def em(self, p: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
        """Proportions of the languages that p has columns for, and the log-likelihood."""
        share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
        for _ in range(rounds):
            mass = p @ share
            new = share * ((n / mass) @ p) / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, g: np.ndarray) -> tuple[str, float, list[tuple[str, float]], float]:
        """Main language, score, the chosen languages with their proportions, and the share of noise.

        Languages join the set one at a time, the one with the largest share of the full mixture first, while
        twice the gain in log-likelihood exceeds penalty x log(n-grams). The score is the main language's
        proportion times its posterior against the other single languages; ties go to the first by name.
        """
        count = np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(count)
        n, p = count[at].astype(np.float64), self.p[at]
        one = n @ self.log[at]
        k = len(self.langs)
        best = int(one[:k].argmax())
        share, top = self.em(p, n)
        noise = float(share[k])
        chosen, value = [best], float(one[best])
        part = np.ones(1)
        cost = self.penalty * math.log(max(2.0, n.sum())) / 2
        for j in sorted((j for j in range(k) if j != best), key=lambda j: -share[j]):
            if share[j] < 0.02 or top - value < cost:
                break
            new, got = self.em(p[:, [*chosen, j]], n)
            if got - value <= cost:
                break
            chosen, value, part = [*chosen, j], got, new
        main = max(range(len(chosen)), key=lambda i: (part[i], -chosen[i]))
        rel = one[:k] - one[chosen[main]]
        alone = 1 / np.exp(np.clip(rel / max(1.0, math.sqrt(n.sum())), -50, 50)).sum()
        score = min(1.0, max(0.0, float(part[main]) * (0.5 + 0.5 * alone)))
        mix = sorted(((self.langs[c], float(s)) for c, s in zip(chosen, part, strict=True)), key=lambda x: -x[1])
        return self.langs[chosen[main]], score, mix, noise


def train(docs: DataFrame, per_language: int = 2000) -> Mixture | None:
    """Fit on whole texts of a sample of labelled rows: about ``per_language`` of each language, by a hash of doc_id.

    Only (language, counts) vectors reach the driver, 8 for each language. No labelled row: None.
    """
    spark = ready(docs.sparkSession)
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return None
    part = F.lit(1.0)
    for lang, n in have.items():
        if n > per_language:
            part = F.when(F.col("lang") == lang, per_language / n).otherwise(part)
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))

    @trimmed
    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "text"):
                buf, off = utf8(b.column(1))
                for lang, a, z in zip(b.column(0).to_pylist(), off[:-1], off[1:], strict=True):
                    held[lang] = held.get(lang, 0) + np.bincount(grams(buf[a:z]), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], ["lang", "counts"])

    got = rows.select("lang", "text").repartition(8).mapInArrow(count, "lang string, counts binary").collect()
    langs = sorted({r["lang"] for r in got})
    total = np.zeros((len(langs), BUCKETS))
    for r in got:
        total[langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    return Mixture(langs, total) if langs else None


RESULT = "doc_id long, lang_pred string, score double, noise double, languages array<struct<lang:string,share:double>>"


def inferred(m: Mixture | None, texts: pa.Array) -> list[tuple[str, float, list[tuple[str, float]], float]]:
    """Main language, score, proportions and share of noise of each text."""
    buf, off = utf8(texts)
    out = []
    for t, a, z in zip(texts.to_pylist(), off[:-1], off[1:], strict=True):
        g = grams(buf[a:z]) if m and t and any(map(str.isalpha, t)) else ()
        out.append(m.infer(g) if len(g) else (UNKNOWN, 0.0, [], 1.0))
    return out


def identify(docs: DataFrame, model: Mixture | None) -> DataFrame:
    """Per row of docs (doc_id, text): lang_pred, score, share of noise, languages with proportions.

    ``und`` with score 0 if the text is null or has no letter (or no language was learned). Only text is read.
    Repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                out = inferred(shared.value, b.column(1))
                mix = pa.array([[{"lang": x, "share": s} for x, s in o[2]] for o in out], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (3, pa.float64()))), mix], ["doc_id", "lang_pred", "score", "noise", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from rows outside fold 2 of 4 (by doc_id) with a text, a language and an id, and predict every row.

    Rows without doc_id are held out of nothing and teach nothing; nulls, repeats and empty tables as in identify().
    """
    model = train(docs.filter(fold(4) != 2))
    return identify(docs, model).select("doc_id", (F.coalesce(fold(4), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score", "noise", "languages")


def with_language(docs: DataFrame, least_noise: float = 0.8) -> DataFrame:
    """docs without the texts that have no language: ``und``, or explained as noise for ``least_noise`` of their n-grams.

    Each row is judged by its own text, whatever its doc_id; all columns stay. Where no language can be learned (no
    label outside the held-out fold, an empty table), only texts that are null or have no letter go.
    """
    model = train(docs.filter(fold(4) != 2))
    if model is None:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: np.array([x[0] != UNKNOWN and x[3] < least_noise for x in inferred(shared.value, texts)], bool))
