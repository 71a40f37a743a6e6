"""The scalar library: a Spark SQL text for each function and number of arguments."""

from __future__ import annotations

import re
from collections.abc import Callable


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _substr(s: str, start: str, size: str | None = None) -> str:
    """1-based; place 0 holds nothing; a negative start counts from the end; a negative size takes what precedes."""
    t, n, a = _text(s), f"CHAR_LENGTH({_text(s)})", f"CAST({start} AS BIGINT)"
    lo = f"(CASE WHEN {a} < 0 THEN {n} + {a} + 1 ELSE {a} END)"
    if size is None:
        return f"SUBSTRING({t}, CAST(GREATEST({lo}, 1) AS INT), CAST({n} AS INT))" if start else t
    z = f"CAST({size} AS BIGINT)"
    first = f"(CASE WHEN {z} < 0 THEN {lo} + {z} ELSE {lo} END)"
    last = f"(CASE WHEN {z} < 0 THEN {lo} ELSE {lo} + {z} END)"
    return f"SUBSTRING({t}, CAST(GREATEST({first}, 1) AS INT), CAST(GREATEST({last} - GREATEST({first}, 1), 0) AS INT) + CAST(0 * {z} AS INT))"


def _ranges(chars: str) -> str:
    """A literal list of characters with its ranges (``a..z``) written out."""
    if not re.fullmatch(r"'.*'", chars, re.S) or ".." not in chars:
        return chars
    return re.sub(r"([^\\'])\.\.([^\\'])", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))) if m[1] <= m[2] else m[0], chars)


def _trim(side: str) -> Callable[..., str]:
    def one(s: str, chars: str = r"' \t\n\r\0\u000B'") -> str:
        return f"TRIM({side} {_ranges(chars)} FROM {_text(s)})"

    return one


def _place(h: str, n: str) -> str:
    """The byte at which a text begins in another, from 1."""
    at = f"INSTR({_text(h)}, {_text(n)})"
    return f"CAST(IF({at} = 0, 0, OCTET_LENGTH(LEFT({_text(h)}, {at} - 1)) + 1) AS BIGINT)"


def _round(x: str, d: str = "0") -> str:
    if re.fullmatch(r"\(?-?\d+\)?", d):
        return f"ROUND({_num(x)}, {d})"
    scale = f"POWER(10D, CAST({d} AS INT))"
    return f"(ROUND({_num(x)} * {scale}, 0) / {scale})"


_SMALL, _LARGE = (f"'{''.join(map(chr, range(a, a + 26)))}'" for a in (97, 65))


def _pad(name: str) -> Callable[..., str]:
    def one(s: str, n: str, p: str = "' '") -> str:
        size = f"CAST({n} AS INT)"
        return f"(CASE WHEN {size} <= 0 THEN IF({s} IS NULL OR {p} IS NULL, NULL, '') WHEN {p} = '' THEN LEFT({_text(s)}, {size}) ELSE {name}({_text(s)}, {size}, {p}) END)"

    return one


def _num(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _power(a: str, b: str) -> str:
    p = f"POWER({_num(a)}, {_num(b)})"
    return f"(CASE WHEN ISNAN({p}) OR ({_num(a)} = 0 AND {_num(b)} < 0) THEN NULL WHEN ABS({p}) = DOUBLE('infinity') THEN RAISE_ERROR('POWER overflows') ELSE {p} END)"


#: name -> (fewest arguments, most, template)
SCALARS: dict[str, tuple[int, int, Callable[..., str]]] = {
    "upper": (1, 1, lambda x: f"TRANSLATE({_text(x)}, {_SMALL}, {_LARGE})"),
    "lower": (1, 1, lambda x: f"TRANSLATE({_text(x)}, {_LARGE}, {_SMALL})"),
    **dict.fromkeys(("length", "len", "octet_length"), (1, 1, lambda x: f"CAST(OCTET_LENGTH({_text(x)}) AS BIGINT)")),
    **dict.fromkeys(("char_length", "character_length"), (1, 1, lambda x: f"CAST(CHAR_LENGTH({_text(x)}) AS BIGINT)")),
    "trim": (1, 2, _trim("BOTH")),
    "ltrim": (1, 2, _trim("LEADING")),
    "rtrim": (1, 2, _trim("TRAILING")),
    **dict.fromkeys(("substr", "substring"), (2, 3, _substr)),
    "concat": (1, 99, lambda *x: f"CONCAT({', '.join(f"COALESCE({_text(a)}, '')" for a in x)})"),
    "replace": (3, 3, lambda s, a, b: f"IF({a} = '' AND {b} IS NOT NULL, {_text(s)}, REPLACE({_text(s)}, {_text(a)}, {_text(b)}))"),
    "instr": (2, 2, _place),
    "repeat": (2, 2, lambda s, n: f"IF(OCTET_LENGTH({_text(s)}) * CAST({n} AS BIGINT) > 16777216, RAISE_ERROR('REPEAT makes more than 16 MiB'), REPEAT({_text(s)}, CAST({n} AS INT)))"),
    "reverse": (1, 1, lambda x: f"REVERSE({_text(x)})"),
    "lpad": (2, 3, _pad("LPAD")),
    "rpad": (2, 3, _pad("RPAD")),
    "abs": (1, 1, lambda x: f"ABS({x})"),
    "round": (1, 2, _round),
    "floor": (1, 1, lambda x: f"CAST(FLOOR({x}) AS DOUBLE)"),
    **dict.fromkeys(("ceil", "ceiling"), (1, 1, lambda x: f"CAST(CEIL({x}) AS DOUBLE)")),
    "mod": (2, 2, lambda a, b: f"TRY_MOD({a}, {b})"),
    "sign": (1, 1, lambda x: f"CAST(SIGN({_num(x)}) AS INT)"),
    **dict.fromkeys(("power", "pow"), (2, 2, _power)),
    "sqrt": (1, 1, lambda x: f"(CASE WHEN {_num(x)} < 0 THEN NULL ELSE SQRT({_num(x)}) END)"),
    "exp": (1, 1, lambda x: f"(CASE WHEN {_num(x)} > 709.782712893384D THEN RAISE_ERROR('EXP overflows') ELSE EXP({_num(x)}) END)"),
    "ln": (1, 1, lambda x: f"(CASE WHEN {_num(x)} <= 0 THEN NULL ELSE LN({_num(x)}) END)"),
    "coalesce": (1, 99, lambda *x: f"COALESCE({', '.join(x)})"),
    **dict.fromkeys(("ifnull", "nvl"), (2, 2, lambda a, b: f"COALESCE({a}, {b})")),
    "nullif": (2, 2, lambda a, b: f"NULLIF({a}, {b})"),
}


def affinity(kind: str) -> str:
    """SQLite affinity of a type name."""
    k = kind.lower()
    if "int" in k:
        return "integer"
    if any(x in k for x in ("char", "clob", "text", "blob", "binary", "date", "time")):
        return "text"
    return "real"


def cast(x: str, kind: str) -> str:
    """CAST by affinity: numbers take the longest numeric prefix of a text, 0 without one."""
    to = affinity(kind)
    flag = f"CAST(TRY_CAST({x} AS BOOLEAN) AS INT)"
    if to == "text":
        return f"IF(TYPEOF({x}) = 'boolean', CAST({flag} AS STRING), {_text(x)})"
    pattern, spark = (r"^\\s*[+-]?\\d+", "BIGINT") if to == "integer" else (r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?", "DOUBLE")
    prefix = f"COALESCE(TRY_CAST(TRIM(REGEXP_EXTRACT({_text(x)}, '{pattern}', 0)) AS {spark}), CAST(0 AS {spark}))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN TYPEOF({x}) = 'string' THEN {prefix} ELSE TRY_CAST({x} AS {spark}) END)"
