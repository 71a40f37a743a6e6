"""The stages and the whole pipeline against plain Python, on rows with null and repeated ids and clashing column names."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm import common, exact, langid, tokens

EN = "the quick brown fox jumps over the lazy dog and then it runs through the green forest again"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den grünen wald"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __may string, may string, node string, sha string, gone string, same string, c0 string, one string, part string, `a b.c` string, h long"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(seed, n=60, of=EN):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(of.split()) for _ in range(n))


def table():
    """(doc_id, text, lang)"""
    out = [(i, prose(i, 30 + i), "en") for i in range(30)] + [(100 + i, prose(i, 40, DE), "de") for i in range(12)]
    one = prose(999, 80)
    near = one.split()
    near[3] = "cat"
    also = one.split()
    also[-2] = "mouse"
    out += [(200, one, "en"), (None, " ".join(near), "en"), (201, " ".join(also), None)]  # near copies, one without an id
    out += [(None, prose(500), "en"), (None, prose(501), "en"), (5, prose(502), "en"), (5, prose(503), None)]  # texts of their own
    out += [(7, prose(7, 37), "en"), (None, prose(7, 37), None), (3, "  " + prose(7, 37).replace(" ", "  "), "en")]  # copies
    out += [(None, None, None), (300, None, "en"), (301, "", "en"), (None, "", None), (302, " \n ", "en"), (303, "12 !! 34", "en"), (None, "12 !! 34", "en")]
    out += [(400, prose(77) + " " + LEAK, "en"), (None, LEAK, "en"), (5, LEAK + " " + prose(78), "en")]
    out += [(500, prose(88), "en")] * 3 + [(None, prose(89), "en")] * 2
    return out


LEAK = "which of these seven rivers flows north through an old town before it meets the salt lake near our border"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, LEAK), (2, None), (3, ""), (4, "the quick brown")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    frame(spark, table()).write.parquet(f"{path}/documents.parquet")
    return path


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", "z", "u", "v", "w", "p", "q", "r", "s", 9) for i, t, lang in rows], COLUMNS).repartition(3)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def first(rows, key):
    """The row of the smallest doc_id (null last) for each key."""
    best = {}
    for i, t in rows:
        k = key(i, t)
        if k not in best or (i is None, i or 0, t or "") < (best[k][0] is None, best[k][0] or 0, best[k][1] or ""):
            best[k] = (i, t)
    return Counter(best.values())


def want_language(spark, rows):
    model = langid.train(frame(spark, rows).filter(common.fold(4) != 2))
    import pyarrow as pa

    said = langid.inferred(model, pa.array([t for _, t, _ in rows], pa.string()))
    return Counter((i, t) for (i, t, _), x in zip(rows, said, strict=True) if x[0] != "und" and x[3] < 0.8)


def want_exact(rows):
    return first(rows, lambda _, t: re.sub(r"[\x20\x09-\x0d]+", " ", t or ""))


def want_near(rows):
    rows = sorted(set(rows), key=repr)
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    part = {r: find(k) for k, r in enumerate(rows)}
    return first([r for r in rows if words(r[1])], lambda i, t: part[i, t])


def want_clean(rows):
    item = shingles(LEAK)
    return Counter(r for r in rows if 100 * len(item & shingles(r[1])) < 75 * len(item) and words(r[1]) != ["the", "quick", "brown"])


def test_stages_judge_rows_and_not_ids(spark, sf_dir):
    rows = table()
    docs = frame(spark, rows)
    flat = [(i, t) for i, t, _ in rows]
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup", "decontamination"):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = pairs(out)
        if name == "language_id":
            assert got == want_language(spark, rows)
            assert {(None, prose(500)), (5, prose(503)), (5, prose(502))} <= set(got) and not any(r[1] in (None, "", "12 !! 34") for r in got)
        elif name == "exact_dedup":
            assert got == want_exact(flat)
            assert got[5, prose(502)] == got[5, prose(503)] == got[None, prose(500)] == got[500, prose(88)] == 1 and (None, prose(7, 37)) not in got
        elif name == "near_dedup":
            blank = Counter(r for r in flat if not words(r[1]))
            assert got == want_near(flat) + blank
            assert [t for i, t in got if prose(999, 80)[:40] == (t or "")[:40] or i == 201] == [prose(999, 80)]
        else:
            assert got == want_clean(flat)
            assert (None, prose(500)) in got and (None, LEAK) not in got


def test_stages_on_empty_tables(spark, sf_dir):
    docs = frame(spark, table()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_the_whole_run(spark, sf_dir):
    rows = table()
    left = list(want_language(spark, rows).elements())
    left = list(want_exact(left).elements())
    left = list(want_near(left).elements())
    left = list(want_clean(left).elements())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    tok = tokens.WordEncoder(tokens.default_vocabulary()).tok
    want = Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    seen = Counter()
    for r in got:
        seen[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert seen == Counter({k: k[1] * n for k, n in want.items()})


def test_pipeline_on_the_given_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_rounds_of_filters_change_nothing(spark, monkeypatch):
    rows = [(i, f"text {i % 37} {'same' if i % 3 else i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, exact.exact_groups(df).collect()))
    monkeypatch.setattr(exact, "ROUND", 64)
    assert sorted(map(tuple, exact.exact_groups(df).collect())) == want


def test_a_full_filter_has_no_false_negative(spark, monkeypatch):
    monkeypatch.setattr(common.Bits, "MOST", 1 << 16)
    df = spark.range(30_000).selectExpr("xxhash64(id) h")
    bits = common.Bits(30_000, planes=2).build(df.union(df.limit(5000)), "h")
    import numpy as np

    h = np.array([r[0] for r in df.collect()], np.int64)
    assert bits.test(h).all() and bits.test(h[:5000], 1).all()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        common.scratch_path(Session(), "x")
