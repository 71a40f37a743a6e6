"""Standalone conditions, and the filter notation of URLs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F



def like(column: Column, pattern: str) -> Column:
    """LIKE without regard to case; a backslash is an ordinary character."""
    return column.cast("string").ilike(pattern.replace("\\", "\\\\"))


@dataclass(frozen=True)
class Bind:
    """A value that bind() fills in later."""

    name: str


@dataclass(frozen=True)
class Predicate:
    """An immutable AND-list of (column, operator, value)."""

    parts: tuple = ()
    impossible: bool = False

    def _and(self, column: str, op: str, value: Any) -> Predicate:
        return Predicate((*self.parts, (column, op, value)), self.impossible)

    def eq(self, column: str, value: Any) -> Predicate:
        return self._and(column, "eq", value)

    def lt(self, column: str, value: Any) -> Predicate:
        return self._and(column, "lt", value)

    def lte(self, column: str, value: Any) -> Predicate:
        return self._and(column, "lte", value)

    def gt(self, column: str, value: Any) -> Predicate:
        return self._and(column, "gt", value)

    def gte(self, column: str, value: Any) -> Predicate:
        return self._and(column, "gte", value)

    def in_(self, column: str, values: list) -> Predicate:
        return self._and(column, "in", tuple(values))

    def like(self, column: str, pattern: str) -> Predicate:
        return self._and(column, "like", pattern)

    @staticmethod
    def never() -> Predicate:
        return Predicate((), True)

    @property
    def empty(self) -> bool:
        return not self.parts and not self.impossible

    def bind(self, **values: Any) -> Predicate:
        """Fill in some of the Bind values; unknown names are an error."""
        names = {v.name for _, _, v in self.parts if isinstance(v, Bind)}
        if extra := set(values) - names:
            raise KeyError(f"no parameter {sorted(extra)[0]}")
        return Predicate(tuple((c, o, values.get(v.name, v) if isinstance(v, Bind) else v) for c, o, v in self.parts), self.impossible)

    def column(self) -> Column:
        if left := [v.name for _, _, v in self.parts if isinstance(v, Bind)]:
            raise ValueError(f"no value for parameter {left[0]}")
        out = F.lit(not self.impossible)
        for c, op, v in self.parts:
            out = out & condition(F.col(c), op, v)
        return out

    def test(self, row: Any) -> bool:
        """Whether one row (a mapping or Row) satisfies it; a missing column is an error."""
        row = row.asDict() if hasattr(row, "asDict") else row
        return not self.impossible and all(_holds(row[c], o, v) for c, o, v in self.parts)


def _holds(x: Any, op: str, v: Any) -> bool:
    if op == "eq" and v is None:
        return x is None
    if x is None or v is None:
        return False
    if op == "like":
        form = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in v)
        return re.fullmatch(form, str(x), re.I | re.S) is not None
    return {"eq": lambda: x == v, "lt": lambda: x < v, "lte": lambda: x <= v, "gt": lambda: x > v, "gte": lambda: x >= v, "in": lambda: x in v}[op]()


def condition(c: Column, op: str, v: Any) -> Column:
    if op == "eq":
        return c.isNull() if v is None else c == v
    if op == "in":
        return c.isin(list(v)) if v else F.lit(False)
    if op == "like":
        return like(c, v)
    return {"lt": c < v, "lte": c <= v, "gt": c > v, "gte": c >= v}[op]


def any_of(predicates: list[Predicate]) -> Column:
    """OR of predicates, two or more; empty ones are left out."""
    if len(predicates) < 2:
        raise ValueError("or_ takes two predicates or more")
    return reduce(Column.__or__, [p.column() for p in predicates if not p.empty], F.lit(False))


_KEY = re.compile(r"(\w+)(?::(eq|gt|gte|lt|lte|like))?")


def from_url(query: str, allowed: list[str] | None = None) -> Predicate:
    """Conditions such as ``age:gte=18&name:like=*x*``: ``*`` stands for any text; numbers compare as numbers."""
    out = Predicate()
    for key, value in parse_qsl(query, keep_blank_values=True):
        m = _KEY.fullmatch(key)
        if not m or (allowed is not None and m[1] not in allowed):
            raise ValueError(f"cannot filter by {key!r}")
        op = m[2] or "eq"
        if op == "like":
            out = out.like(m[1], value.replace("*", "%"))
        else:
            number = float(value) if re.fullmatch(r"-?\d+\.\d+", value) else int(value) if re.fullmatch(r"-?\d+", value) else value
            out = out._and(m[1], op, number)
    return out
