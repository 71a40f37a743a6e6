"""The immutable fluent query over one relation, and a small collection for its results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from millrace.operators.predicate import Bind, Predicate, any_of, condition, from_url


class Collection(list):
    """Results in memory."""

    def map(self, fn: Callable) -> Collection:
        return Collection(fn(x) for x in self)

    def filter(self, fn: Callable) -> Collection:
        return Collection(x for x in self if fn(x))

    def reduce(self, fn: Callable, start: Any) -> Any:
        for x in self:
            start = fn(start, x)
        return start

    def any(self, fn: Callable) -> bool:
        return any(map(fn, self))

    def all(self, fn: Callable) -> bool:
        return all(map(fn, self))

    def none(self, fn: Callable) -> bool:
        return not self.any(fn)

    def find(self, fn: Callable) -> Any:
        return next((x for x in self if fn(x)), None)

    def first(self) -> Any:
        return self[0] if self else None

    def last(self) -> Any:
        return self[-1] if self else None


class Query:
    """Each method returns a new query; nothing runs before results are asked for.

    ``limit`` only shrinks and ``offset`` adds up within what is left; a filter after them applies to the page.
    """

    def __init__(self, df: DataFrame, engine=None, *, pk: list[str] | None = None, sort: tuple = (), start: int = 0, size: int | None = None, more: dict | None = None, props: dict | None = None) -> None:
        self._df, self._engine, self._pk, self._sort, self._start, self._size = df, engine, pk or [], sort, start, size
        self._more, self._props = more or {}, props or {}

    def _but(self, **parts) -> Query:
        now = {"pk": self._pk, "sort": self._sort, "start": self._start, "size": self._size, "more": self._more, "props": self._props} | parts
        return type(self)(now.pop("df", self._df), self._engine, **now)

    def with_property(self, name: str, value: Any) -> Query:
        """A note that goes along with the query."""
        return self._but(props=self._props | {name: value})

    def get_property(self, name: str, default: Any = None) -> Any:
        return self._props.get(name, default)

    def template(self) -> Template:
        """Steps to be taken later, whose values may be Bind names."""
        return Template(self)

    @property
    def df(self) -> DataFrame:
        """The relation as a DataFrame."""
        out = self._df.orderBy(*self._sort) if self._sort else self._df
        if self._start:
            out = out.offset(self._start)
        return out if self._size is None else out.limit(self._size)

    def barrier(self) -> Query:
        """What follows sees the page, not the rows behind it."""
        paged = self._start or self._size is not None
        return self._but(df=self.df, sort=(), start=0, size=None) if paged else self

    def _filter(self, c) -> Query:
        q = self.barrier()
        return q._but(df=q._df.where(c))

    def _cond(self, column: str, op: str, value: Any) -> Query:
        return self._filter(condition(F.col(column), op, value))

    def eq(self, column: str, value: Any) -> Query:
        return self._cond(column, "eq", value)

    def lt(self, column: str, value: Any) -> Query:
        return self._cond(column, "lt", value)

    def lte(self, column: str, value: Any) -> Query:
        return self._cond(column, "lte", value)

    def gt(self, column: str, value: Any) -> Query:
        return self._cond(column, "gt", value)

    def gte(self, column: str, value: Any) -> Query:
        return self._cond(column, "gte", value)

    def like(self, column: str, pattern: str) -> Query:
        return self._cond(column, "like", pattern)

    def in_(self, column: str, values: list | Query | DataFrame) -> Query:
        """Members of a list, or of a one-column query (a semi join)."""
        if isinstance(values, (Query, DataFrame)):
            other = values.df if isinstance(values, Query) else values
            if len(other.columns) != 1:
                raise ValueError("in_ takes one column")
            q = self.barrier()
            return q._but(df=q._df.join(other.toDF("__in"), F.col(column) == F.col("__in"), "left_semi"))
        return self._cond(column, "in", values)

    def or_(self, *predicates: Predicate) -> Query:
        return self._filter(any_of(list(predicates)))

    def matching(self, predicate: Predicate) -> Query:
        return self._filter(predicate.column())

    def url(self, query: str, allowed: list[str] | None = None) -> Query:
        return self._filter(from_url(query, allowed).column())

    def where(self, sql: str, params: list | dict | None = None) -> Query:
        """A condition in SQL, AND-ed; ? and :name take values."""
        return self._sql("SELECT * FROM __this WHERE " + sql, params)

    def _sql(self, sql: str, params: list | dict | None = None, **more: DataFrame) -> Query:
        from millrace.operators.engine import Engine

        q = self.barrier()
        base = self._engine.session() if self._engine else Engine(q._df.sparkSession)
        base.register("__this", q._df)
        for n, df in (self._more | more).items():
            base.register(n, df)
        return q._but(df=base.sql(sql, params))

    def select(self, items: str) -> Query:
        """Expressions with aliases, over the rows so far."""
        q = self._but(df=self.df, sort=(), start=0, size=None)
        return q._sql(f"SELECT {items} FROM __this")

    def columns(self, *names: str) -> Query:
        """Narrow to some columns; an unknown one is an error."""
        if bad := [n for n in names if n not in self._df.columns]:
            raise ValueError(f"no column {bad[0]}")
        q = self._but(df=self.df, sort=(), start=0, size=None) if self._sort or self._start or self._size is not None else self
        return q._but(df=q._df.select(*names))

    def rename(self, alias: str | None = None, columns: dict[str, str] | None = None) -> Query:
        q = self.barrier()
        df = q._df.withColumnsRenamed(columns or {})
        return q._but(df=df.alias(alias) if alias else df)

    def order(self, by: str | None) -> Query:
        """Sort keys as in ``"a ASC, b DESC"``; replaces an earlier order. NULL is the smallest value."""
        keys = []
        for part in (by or "").split(","):
            if part.strip():
                m = re.fullmatch(r"\s*([\w.]+)(?:\s+(asc|desc))?\s*", part, re.I)
                if not m:
                    raise ValueError(f"not a sort key: {part!r}")
                c = F.col(m[1])
                keys.append(c.desc_nulls_last() if (m[2] or "").lower() == "desc" else c.asc_nulls_first())
        return self.barrier()._but(sort=tuple(keys))

    def limit(self, n: int) -> Query:
        return self._but(size=n if self._size is None else min(n, self._size))

    def offset(self, n: int) -> Query:
        return self._but(start=self._start + n, size=None if self._size is None else max(0, self._size - n))

    def distinct(self) -> Query:
        q = self.barrier()
        return q._but(df=q._df.distinct())

    def union(self, other: Query) -> Query:
        """Rows of either, by column name, without repeats."""
        return self._but(df=self.df.unionByName(other.df).distinct(), sort=(), start=0, size=None)

    def except_(self, other: Query) -> Query:
        """Rows that the other has not; NULL equals NULL. Repeats stay."""
        a, b = self.df, other.df
        b = b.select(*(F.col(c).alias(f"__{c}") for c in a.columns)).distinct()
        cond = F.lit(True)
        for c in a.columns:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return self._but(df=a.join(b, cond, "left_anti"), sort=(), start=0, size=None)

    def with_cte(self, name: str, other: Query, sql: str | None = None) -> Query:
        """Let the SQL of later steps name another query; or run SQL over this one (``__this``) and it at once.

        The name of a table or of an earlier one is an error, and so is a query of another session.
        """
        if name.startswith("__") or name in self._more or (self._engine and self._engine.exists(name)):
            raise ValueError(f"{name} is taken")
        if other._df.sparkSession is not self._df.sparkSession:
            raise ValueError(f"{name} belongs to another session")
        q = self._but(more=self._more | {name: other.df})
        return q if sql is None else q._sql(sql)

    # results
    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def all(self) -> Collection:
        return Collection(self.df.collect())

    def one(self) -> Row | None:
        return self.limit(1).df.first()

    first = one

    def column(self) -> list:
        return [r[0] for r in self.df.collect()]

    def field(self) -> Any:
        row = self.one()
        return None if row is None else row[0]

    def exists(self) -> bool:
        return not self.limit(1).df.isEmpty()

    def count(self) -> int:
        return (self._but(sort=()) if not self._start and self._size is None else self).df.count()

    def load(self, key: Any) -> Row | None:
        """The row of a primary key."""
        if len(self._pk) != 1:
            raise ValueError("the table has no primary key of one column")
        return self.eq(self._pk[0], key).one()

    def has(self, member: dict) -> bool:
        q = self
        for c, v in member.items():
            q = q.eq(c, v)
        return q.exists()

    def map(self, fn: Callable) -> Collection:
        return self.all().map(fn)

    def hydrate(self, cls: type) -> Collection:
        """Each row as an object of a class that takes the columns by name."""
        return self.all().map(lambda r: cls(**r.asDict()))

    def json(self) -> str:
        return json.dumps([json.loads(x) for x in self.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toDF("j").toPandas()["j"]])

    def explain(self) -> None:
        self.df.explain("formatted")


class PlainQuery(Query):
    """A query whose limit and offset replace earlier ones."""

    def limit(self, n: int) -> Query:
        return self._but(size=n)

    def offset(self, n: int) -> Query:
        return self._but(start=n)


class Template:
    """Recorded steps of a query; bind() gives values to some or all of their names, ``query`` takes the steps."""

    STEPS = ("eq", "lt", "lte", "gt", "gte", "like", "in_", "or_", "matching", "where", "order", "limit", "offset", "columns", "select", "rename", "distinct")

    def __init__(self, base: Query, steps: tuple = ()) -> None:
        self._base, self._steps = base, steps

    def __getattr__(self, name: str) -> Callable[..., Template]:
        if name not in self.STEPS:
            raise AttributeError(name)
        return lambda *args: Template(self._base, (*self._steps, (name, args)))

    def names(self) -> set[str]:
        """What still has no value."""
        return {n for _, args in self._steps for a in args for n in _binds(a)}

    def bind(self, **values: Any) -> Template:
        if extra := set(values) - self.names():
            raise KeyError(f"no parameter {sorted(extra)[0]}")
        return Template(self._base, tuple((name, tuple(_filled(a, values) for a in args)) for name, args in self._steps))

    @property
    def query(self) -> Query:
        if left := self.names():
            raise ValueError(f"no value for parameter {sorted(left)[0]}")
        out = self._base
        for name, args in self._steps:
            out = getattr(out, name)(*args)
        return out


def _binds(a: Any) -> set[str]:
    if isinstance(a, Bind):
        return {a.name}
    if isinstance(a, Predicate):
        return {n for _, _, v in a.parts for n in _binds(v)}
    return {n for x in a for n in _binds(x)} if isinstance(a, (list, tuple)) else set()


def _filled(a: Any, values: dict) -> Any:
    if isinstance(a, Bind):
        return values.get(a.name, a)
    if isinstance(a, Predicate):
        return a.bind(**{k: v for k, v in values.items() if k in _binds(a)})
    return type(a)(_filled(x, values) for x in a) if isinstance(a, (list, tuple)) else a
