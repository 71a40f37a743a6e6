"""Secrets by pattern and by a battery of randomness tests; built-in expressions only.

A run of 20 or more characters of a text encoding is a candidate. Its encoding (hex, base32, base64) is inferred
(digits alone, or letters of one case, are none),
then three tests ask whether its code values are uniform and independent: chi-squared over the alphabet (over cells
of it where a run is too short for its signs), runs
above and below the middle, serial correlation. Their sum of squares gives a p-value. In each band of encoding
and length, a Benjamini-Hochberg step over all candidates of the table rejects those that are not random; what it
cannot reject is reported. Where a band still holds more survivors than its likely random ones explain, its
threshold rises until few of them are false, and if HIGHEST does not do, the band reports none. The shortest length reported depends on the encoding, since short runs tell too little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, ready

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets of the encodings, in the order of their code values (fixed values).
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
SHORTEST = {"hex": 24, "base32": 26, "base64": 20}
#: Parts of a text that are walked at once (even).
STRETCH = 256
#: Cells of the base64 alphabet for short runs: capitals, frequent and other small letters, digits, signs (their sizes in order).
CELLS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "etaoinsr", "bcdfghjklmpquvwxyz", "0123456789", "+/")
_MARK, _OTHER = "￿", "￾"
BINS = 128
#: Of random strings of any encoding and length, so many have a p-value above 0.5, and 1 - SLOPE x t one above t <= 0.5 (by simulation).
ABOVE_HALF, SLOPE = 0.63, 0.74
#: The bin of the largest threshold (2 ** -3.5, about 0.09) of a band that still reports.
HIGHEST = 7


def marked(text: Column, pattern: str) -> Column:
    """A text (without the mark) cut at its matches: every second part is a match."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def located(parts: Column) -> Column:
    """The matches among marked parts, in order: array of (s, e, x), in code points.

    Parts are walked in stretches of STRETCH, each with places of its own, so that work grows with their number alone.
    """
    kind = "cast(array() as array<struct<s:bigint,e:bigint,x:string>>)"
    none, zero = F.expr(kind), F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        more = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("x"))))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], more).otherwise(acc["out"]).alias("out"))

    def walk(some: Column) -> Column:
        return F.aggregate(some, F.struct(zero.alias("at"), F.lit(False).alias("hit"), none.alias("out")), step)

    def place(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["begin"], F.array(acc["at"])).alias("begin"))

    cuts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STRETCH).cast("int"))
    walked = F.transform(cuts, lambda k: walk(F.slice(parts, k * STRETCH + 1, F.lit(STRETCH))))  # STRETCH is even: each begins outside a match
    long = F.transform(F.array(walked), lambda w: F.flatten(F.transform(F.arrays_zip(w.alias("w"), _begins(w, place, zero).alias("b")), lambda z: F.transform(z["w"]["out"], lambda m: F.struct((m["s"] + z["b"]).alias("s"), (m["e"] + z["b"]).alias("e"), m["x"].alias("x"))))))
    return F.when(F.size(parts) <= 1, none).when(F.size(parts) <= STRETCH, walk(parts)["out"]).otherwise(F.coalesce(F.element_at(long, 1), none))


def _begins(walked: Column, place, zero: Column) -> Column:
    """Where each stretch begins."""
    return F.aggregate(walked, F.struct(zero.alias("at"), F.expr("cast(array() as array<bigint>)").alias("begin")), place)["begin"]


def _tail(t: Column) -> Column:
    """Chance that a chi-squared variable of 3 degrees exceeds t (rational approximation of erfc)."""
    x = F.sqrt(t / 2)
    u = 1 / (1 + 0.3275911 * x)
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return F.greatest(F.lit(1e-18), (poly + 2 * x / 1.7724538509055159) * F.exp(-x * x))


def battery(run: Column) -> Column:
    """(enc, n, p) of a run: its inferred encoding, length and the p-value of randomness."""
    word = F.translate(run, "-_", "+/")
    enc = (
        F.when(run.rlike("^([0-9]+|[A-Za-z]?[a-z]+|[A-Z]+)$"), F.lit("none"))
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(run.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .otherwise(F.lit("base64"))
    )
    s = F.when(enc == "hex", F.lower(run)).otherwise(word)
    alphabet, k = F.lit(ALPHABETS["base64"]), F.lit(64.0)
    for name in ("hex", "base32"):
        alphabet, k = F.when(enc == name, ALPHABETS[name]).otherwise(alphabet), F.when(enc == name, float(len(ALPHABETS[name]))).otherwise(k)
    chars = F.split(s, "")
    n = F.length(s).cast("double")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
    df = k - 1
    # a run too short for five of each of 64 signs has its signs counted by cells, which also tells words from keys
    cells = sum((F.pow(n - F.length(F.translate(s, c, "")), F.lit(2.0)) * 64.0 / len(c) for c in CELLS), F.lit(0.0))
    few = (k == 64) & (n < 320)
    own = F.when(few, float(len(CELLS) - 1)).otherwise(df)
    chi = F.greatest(F.lit(0.0), F.when(few, cells / n - n).otherwise(squares * k / n - n))
    z1 = F.greatest(F.lit(0.0), (F.pow(chi / own, F.lit(1 / 3)) - (1 - 2 / (9 * own))) / F.sqrt(2 / (9 * own)))
    codes = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double") - 1)
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("prod"))

    def step(a: Column, v: Column) -> Column:
        first = a["last"] < 0
        turn = F.when(~first & ((a["last"] * 2 >= k) != (v * 2 >= k)), 1.0).otherwise(0.0)
        prod = F.when(first, 0.0).otherwise((a["last"] - df / 2) * (v - df / 2))
        return F.struct(v.alias("last"), (a["runs"] + turn).alias("runs"), (a["prod"] + prod).alias("prod"))

    def close(a: Column) -> Column:
        z2 = (a["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z3 = a["prod"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        return _tail(z1 * z1 + z2 * z2 + z3 * z3)

    p = F.when(enc == "none", F.lit(0.0)).otherwise(F.aggregate(codes, start, step, close))
    return F.struct(enc.alias("enc"), F.length(s).cast("long").alias("n"), p.alias("p"))


def _band(c: Column) -> Column:
    return F.concat_ws(":", c["enc"], F.floor(2 * F.log2(c["n"].cast("double"))).cast("string"))


def _thresholds(found: DataFrame, rate: float, false: float = 0.05) -> dict[str, float]:
    """Per band the largest p-value that is rejected, from a histogram of half powers of two; no entry: none is.

    At first that of Benjamini-Hochberg. It rises while survivors outnumber the random strings that the p-values above
    0.5 stand for by more than ``false`` of them and two standard deviations. A band where that goes on beyond HIGHEST
    has the threshold 1: so many of its strings only look random that none is reported.
    At most a few hundred bands of 128 bins reach the driver, at any input size.
    """
    each = found.select(F.explode("cands").alias("c")).select(_band(F.col("c")).alias("band"), F.least(F.lit(BINS - 1), F.floor(-2 * F.log2(F.greatest(F.lit(1e-18), F.col("c.p"))))).cast("int").alias("bin"))
    held: dict[str, dict[int, int]] = {}
    for r in each.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        held.setdefault(r["band"], {})[r["bin"]] = r["n"]
    out = {}
    for band, bins in held.items():
        total, below, last = sum(bins.values()), 0, BINS
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 2.0 ** (-b / 2) <= rate * below / total:
                last = b
        random = sum(n for b, n in bins.items() if b < 2) / ABOVE_HALF
        for b in range(last, min(last, HIGHEST) - 1, -1):
            last, above = b, sum(n for k, n in bins.items() if k < b)
            if above - random * (1 - SLOPE * 2.0 ** (-b / 2)) <= false * above + 2 * above**0.5:
                break
        else:
            last = 0  # the band reports nothing
        if last < BINS:
            out[band] = 2.0 ** (-last / 2)
    return out


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per row of docs: doc_id, base (array of s, k, e by start, then kind), random (the same, of added spans).

    Null and empty texts have none. Repeated rows give repeated results; an empty table gives none. A candidate
    that overlaps a base span adds nothing. Columns other than doc_id and text are ignored.
    """
    ready(docs.sparkSession)
    text, col = F.col("t"), F.col
    # a text cannot keep the mark: its neighbour, which no pattern tells apart, stands in for it
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.translate(F.coalesce("text", F.lit("")), _MARK, _OTHER).alias("t"))
    rows = rows.withColumns({"run": marked(text, RUN), "access": F.when(F.contains(text, F.lit("AKIA")), marked(text, ACCESS)), "assign": F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), marked(text, ASSIGN))})
    rows = rows.withColumn("hex", F.when(F.size("run") > 1, marked(text, HEX)))
    rows = rows.select("doc_id", *(located(col(k)).alias(k) for k in ("run", "access", "assign", "hex")))

    def kind(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    assign = F.filter(col("assign"), lambda x: F.length(F.regexp_extract(x["x"], ASSIGN, 2)) >= 6)
    base = F.array_sort(F.concat(kind(assign, 0), kind(col("access"), 1), kind(col("hex"), 2)))
    runs = F.transform(col("run"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["x"]).alias("t")))
    cands = F.transform(runs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"]["enc"].alias("enc"), x["t"]["n"].alias("n"), x["t"]["p"].alias("p")))
    found = materialize(rows.select("doc_id", base.alias("base"), cands.alias("cands")), "secrets")
    edges = _thresholds(found, rate)
    limit = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair]) if edges else None

    def reported(c: Column) -> Column:
        least = F.create_map(*[F.lit(x) for pair in SHORTEST.items() for x in pair])
        edge = F.coalesce(limit[_band(c)], F.lit(0.0)) if limit is not None else F.lit(0.0)
        apart = ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return (c["p"] > edge) & (c["n"] >= F.coalesce(least[c["enc"]], F.lit(1 << 30))) & apart

    return found.select("doc_id", "base", kind(F.filter("cands", reported), 3).alias("random"))


def secret_table(docs: DataFrame) -> DataFrame:
    """The counts, the digest of base spans and the list of all spans of each row; nulls, repeats and empty tables as in find_secrets()."""
    found = find_secrets(docs)
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))

    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("base", "random"))
    return found.select("doc_id", *(count(k) for k in range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
