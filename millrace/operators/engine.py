"""The engine: a catalog of named tables, SQL over them, changes to them, and guard rails."""

from __future__ import annotations

import atexit
import itertools
import re
import shutil
import tempfile
import threading
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import affinity
from millrace.operators.query import PlainQuery, Query
from millrace.plans.parser import Node, SqlError, parse, walk
from millrace.plans.render import QUERY, Renderer, bind, quote, refers

_ids = itertools.count(1)
SPARK_TYPES = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType()}


@dataclass(frozen=True)
class Limits:
    """Guard rails; exceeding one is an error that names it."""

    joined_tables: int = 8
    subquery_depth: int = 8
    recursion: int = 10_000
    buffered_writes: int = 1_000_000


class LimitError(RuntimeError):
    pass


@dataclass
class Table:
    """A named table: its rows, keys, and the row scopes that reads and changes are held to."""

    df: DataFrame
    pk: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    readable: str | None = None
    updatable: str | None = None
    deletable: str | None = None
    insertable: bool = True
    defaults: dict[str, str] = field(default_factory=dict)
    writes: int = 0


class Engine:
    """Named tables and SQL over them. ``session()`` shares tables and adds private temporary ones."""

    def __init__(self, spark: SparkSession, limits: Limits | None = None, *, parent: Engine | None = None) -> None:
        self.spark, self.parent, self.id = spark, parent, next(_ids)
        self.limits = limits or (parent.limits if parent else Limits())
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, tuple[str, int]] = dict(parent.functions) if parent else {}
        self.aggregates: dict[str, tuple[str, int]] = dict(parent.aggregates) if parent else {}
        self.timeout: float | None = None
        spark.conf.set("spark.sql.cteRecursionLevelLimit", str(self.limits.recursion))
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    # catalog
    def register(self, name: str, df: DataFrame, pk: list[str] | None = None, unique: list[list[str]] | None = None, **scopes) -> Engine:
        """Name a table. Scopes (readable, updatable, deletable: SQL conditions; insertable) bound what is seen and changed."""
        self.tables[name.lower()] = Table(df, pk or [], unique or [], **scopes)
        return self

    def table(self, name: str) -> Table:
        t = self.tables.get(name.lower()) or (self.parent._find(name) if self.parent else None)
        if t is None:
            raise SqlError(f"no table {name}")
        return t

    def _find(self, name: str) -> Table | None:
        return self.tables.get(name.lower()) or (self.parent._find(name) if self.parent else None)

    def exists(self, name: str) -> bool:
        return self._find(name) is not None

    def names(self) -> list[str]:
        return sorted({*self.tables, *(self.parent.names() if self.parent else ())})

    def schema(self) -> DataFrame:
        """(table_name, name, type, ordinal, is_key) of all columns."""
        rows = [(t, f.name, f.dataType.simpleString(), i, f.name in self.table(t).pk) for t in self.names() for i, f in enumerate(self.table(t).df.schema.fields)]
        return self.spark.createDataFrame(rows, "table_name string, name string, type string, ordinal int, is_key boolean")

    def with_tables(self, tables: dict[str, DataFrame]) -> Engine:
        """A new engine in which these tables shadow those of the same name."""
        out = Engine(self.spark, self.limits)
        out.tables = {n: self.table(n) for n in self.names()}
        out.functions, out.aggregates = dict(self.functions), dict(self.aggregates)
        for n, df in tables.items():
            out.register(n, df)
        return out

    def session(self) -> Engine:
        return Engine(self.spark, parent=self)

    def _view(self, name: str) -> str:
        t = self.table(name)
        view = f"mr_{self.id}_{name.lower()}"
        df = t.df.where(t.readable) if t.readable else t.df
        df.createOrReplaceTempView(view)
        return view

    # functions
    def create_function(self, name: str, fn: Callable, returns: str = "string", args: int = -1) -> None:
        """A scalar function; it gets None for NULL and replaces a built-in of the same name in this engine only."""
        real = f"mr_{self.id}_{name.lower()}"
        self.spark.udf.register(real, F.udf(fn, returns, useArrow=True))
        self.functions[name.lower()] = (real, args)

    def create_aggregate(self, name: str, step: Callable, final: Callable, returns: str = "double", start: Callable = lambda: None, args: int = 1) -> None:
        """An aggregate folded over the values of a group, in no fixed order."""
        real = f"mr_{self.id}_{name.lower()}"

        def fold(values) -> object:
            state = start()
            for v in values.tolist():
                state = step(state, None if v != v else v)
            return final(state)

        fold.__annotations__ = {}
        import pandas as pd

        fold.__annotations__ = {"values": pd.Series, "return": float}
        self.spark.udf.register(real, F.pandas_udf(fold, returns))
        self.aggregates[name.lower()] = (real, args)

    def is_aggregate(self, name: str) -> bool:
        return name.lower() in self.aggregates or name.lower() in ("count", "sum", "avg", "min", "max")

    # reading
    def _columns(self, sql: str) -> list:
        try:
            return [(f.name, f.dataType.simpleString()) for f in self.spark.sql(sql).schema.fields]
        except AnalysisException:
            return []

    def _renderer(self, tree: Node, extra: dict[str, str] | None = None) -> Renderer:
        wanted = {n["name"].lower() for n in walk(tree) if n.k == "table"}
        views = {n: self._view(n) for n in wanted if self.exists(n)}
        return Renderer(views | (extra or {}), self._columns, self.functions, self.aggregates)

    def _guard(self, tree: Node) -> None:
        for n in walk(tree):
            if n.k == "select" and n["src"] is not None:
                count = sum(s.k in ("table", "derived") for s in walk(n["src"], lambda x: x.k == "join"))
                if count > self.limits.joined_tables:
                    raise LimitError(f"{count} joined tables: the limit joined_tables is {self.limits.joined_tables}")

        def depth(x) -> int:
            if isinstance(x, Node):
                below = max((depth(v) for v in x.values()), default=0)
                return below + (x.k in ("sub", "inq", "exists", "quant", "derived"))
            return max((depth(v) for v in x), default=0) if isinstance(x, (list, tuple)) else 0

        if (d := depth(tree)) > self.limits.subquery_depth:
            raise LimitError(f"subqueries {d} deep: the limit subquery_depth is {self.limits.subquery_depth}")

    def sql(self, sql: str, params: list | dict | None = None) -> DataFrame:
        """The rows of a SELECT, VALUES or WITH statement."""
        tree = parse(sql)
        if tree.k not in QUERY:
            raise SqlError("only queries: use exec for changes")
        tree = bind(tree, params if params is not None else [])
        self._guard(tree)
        return self._run(tree)

    def _run(self, tree: Node, extra: dict[str, str] | None = None) -> DataFrame:
        extra = dict(extra or {})
        if tree.k == "with" and tree["recursive"]:
            ctes = []
            for name, cols, body in tree["ctes"]:
                if body.k == "setop" and body["op"] == "union" and refers(body["right"], name) and not refers(body["left"], name):
                    if body["order"] or body["offset"] is not None:
                        raise SqlError("ORDER BY and OFFSET in a recursive table")
                    if not body["all"] or body["limit"] is not None:
                        extra[name.lower()] = self._fixpoint(name, cols, body, Node("with", recursive=True, ctes=ctes, body=None), extra)
                        continue
                ctes.append((name, cols, body))
            tree = tree.but(ctes=ctes, recursive=any(refers(b, n) for n, _, b in ctes)) if ctes else tree["body"]
        r = self._renderer(tree, extra)
        return self.spark.sql(r.query(tree))

    def _fixpoint(self, name: str, cols: list[str] | None, body: Node, before: Node, extra: dict[str, str]) -> str:
        """WITH RECURSIVE ... UNION: repeat on the rows that are new until there are none."""
        lead = lambda q: before.but(body=q) if before["ctes"] else q
        seen = self._run(lead(body["left"]), extra)
        if cols:
            seen = seen.toDF(*cols)
        every = body["all"]
        new, view = self._cut(seen if every else seen.distinct()), f"mr_{self.id}_{name.lower()}_{next(_ids)}"
        seen, parts, rows = new, [new], new.count()
        stop = body["limit"]["v"] if body["limit"] is not None else None
        for _ in range(self.limits.recursion):
            if not parts[-1].take(1) or (stop is not None and rows >= stop):
                break
            new.createOrReplaceTempView(view)
            found = self._run(lead(body["right"]), extra | {name.lower(): view}).toDF(*seen.columns)
            found = found.select(*(F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in seen.schema))
            # what a round finds is written alone; only every 32 rounds are the parts written together
            new = self._cut(found if every else found.distinct().subtract(seen))
            parts.append(new)
            rows += new.count() if stop is not None else 0
            if len(parts) > 32:
                parts = [self._cut(reduce(DataFrame.union, parts[:-1])), new]
            seen = reduce(DataFrame.union, parts)
        else:
            raise LimitError(f"the recursion goes on: the limit recursion is {self.limits.recursion}")
        (seen.limit(stop) if stop is not None else seen).createOrReplaceTempView(view)
        return view

    def _cut(self, df: DataFrame) -> DataFrame:
        """Cut lineage with a checkpoint in the shared folder that the session names (a temporary one on one machine)."""
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            folder = self.spark.conf.get("spark.checkpoint.dir", None)
            if not folder:
                if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
                folder = tempfile.mkdtemp(prefix="millrace-")
                atexit.register(shutil.rmtree, folder, ignore_errors=True)
            context.setCheckpointDir(folder)
        return df.checkpoint()

    def query(self, sql: str, params: list | dict | None = None, ctes: dict[str, Query] | None = None) -> Query:
        """A query; ``ctes`` are relations that its SQL may name (names of tables are taken)."""
        at = self
        for name, other in (ctes or {}).items():
            if self.exists(name) or name.startswith("__"):
                raise ValueError(f"{name} is taken")
            at = at.session() if at is self else at
            at.register(name, other.df)
        return Query(at.sql(sql, params), self)

    def from_table(self, name: str, pages: bool = True) -> Query:
        """A fluent query over a table; without ``pages`` a later limit or offset replaces an earlier one."""
        t = self.table(name)
        return (Query if pages else PlainQuery)(t.df.where(t.readable) if t.readable else t.df, self, pk=t.pk)

    def keep(self, name: str) -> Engine:
        """Hold a table's rows in memory and on disk once they have been read."""
        self.table(name).df.persist()
        return self

    def one(self, sql: str, params=None):
        return self.sql(sql, params).first()

    def value(self, sql: str, params=None):
        row = self.one(sql, params)
        return None if row is None else row[0]

    def column(self, sql: str, params=None) -> list:
        return [r[0] for r in self.sql(sql, params).collect()]

    @contextmanager
    def query_timeout(self, seconds: float):
        """Cancel the jobs of the block when it takes longer."""
        group, sc = f"millrace-{next(_ids)}", self.spark.sparkContext
        sc.setJobGroup(group, "query with a time limit", interruptOnCancel=True)
        timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            sc._jsc.clearJobGroup()

    def transaction(self, fn: Callable):
        return fn(self)

    # changing
    def exec(self, sql: str, params: list | dict | None = None) -> int:
        """Run a change; returns the number of rows inserted, updated or deleted."""
        tree = bind(parse(sql), params if params is not None else [])
        if tree.k in QUERY:
            raise SqlError("exec takes changes: use sql for queries")
        self._guard(tree)
        return getattr(self, "_x_" + tree.k)(tree)

    def _owner(self, name: str) -> Engine:
        return self if name.lower() in self.tables or self.parent is None else self.parent._owner(name)

    def _swap(self, name: str, df: DataFrame) -> None:
        """Put the changed rows in place; the lineage is cut every few changes."""
        t = self._owner(name).table(name)
        writes = t.writes + 1
        self._owner(name).tables[name.lower()] = replace(t, df=self._cut(df) if writes % 8 == 0 else df, writes=writes)

    def _x_insert(self, n: Node) -> int:
        t = self.table(n["table"])
        if not t.insertable:
            raise SqlError(f"{n['table']} takes no rows")
        fields = {f.name.lower(): f for f in t.df.schema}
        cols = [c.lower() for c in n["cols"] or [f.name for f in t.df.schema]]
        if bad := [c for c in cols if c not in fields]:
            raise SqlError(f"no column {bad[0]} in {n['table']}")
        if n["rows"] is not None:
            if any(len(r) != len(cols) for r in n["rows"]):
                raise SqlError("a row has another number of values than columns")
            rows = self._run(Node("values", rows=n["rows"], order=[], limit=None, offset=None))
        else:
            rows = self._run(n["query"])
        if len(rows.columns) != len(cols):
            raise SqlError("the query has another number of columns")
        rows = rows.toDF(*(f"c{i}" for i in range(len(cols))))
        at = {c: f"c{i}" for i, c in enumerate(cols)}
        new = rows.select(*((F.col(at[c]) if c in at else F.expr(t.defaults.get(c, "NULL"))).cast(f.dataType).alias(f.name) for c, f in fields.items()))
        new = self._cut(new)  # read all before anything changes
        count = new.count()
        if count > self.limits.buffered_writes:
            raise LimitError(f"{count} rows to write: the limit buffered_writes is {self.limits.buffered_writes}")
        old = t.df
        if n["replace"] and t.pk:
            order = new.withColumn("__at", F.monotonically_increasing_id())
            last = order.groupBy(*t.pk).agg(F.max("__at").alias("__at")).select("__at")
            new = order.join(last, "__at", "left_semi").drop("__at")
            old = old.join(new.select(*t.pk), t.pk, "left_anti")
        both = old.unionByName(new)
        for key in [k for k in [t.pk, *t.unique] if k]:
            whole = F.lit(True)
            for c in key:
                whole = whole & F.col(quote(c)).isNotNull()
            if not both.where(whole).join(new.select(*key).distinct(), key, "left_semi").groupBy(*key).count().where("count > 1").isEmpty():
                raise SqlError(f"duplicate key ({', '.join(key)}) in {n['table']}")
        self._swap(n["table"], both)
        return count

    def _x_update(self, n: Node) -> int:
        t = self.table(n["table"])
        fields = {f.name.lower(): f for f in t.df.schema}
        if bad := [c for c, _ in n["sets"] if c.lower() not in fields]:
            raise SqlError(f"no column {bad[0]} in {n['table']}")
        if self._by_row(n):
            view, r, scoped = self._scoped(n, t)
            sets = {c.lower(): r.e(v) for c, v in n["sets"]}
            cols = [f"CASE WHEN {scoped} THEN CAST({sets[c]} AS {f.dataType.simpleString()}) ELSE {quote(f.name)} END AS {quote(f.name)}" if c in sets else quote(f.name) for c, f in fields.items()]
            return self._rewritten(n, view, scoped, f"SELECT {', '.join(cols)} FROM {view} AS {quote(n['table'])}")
        every, hit = self._met(n, t)
        count = hit.count()
        new = {c.lower(): f"__new{i}" for i, (c, _) in enumerate(n["sets"])}
        both = every.join(hit.withColumn("__hit", F.lit(True)), "__row", "left")
        cols = [F.when(F.col("__hit"), F.col(new[c]).cast(f.dataType)).otherwise(F.col(quote(f.name))).alias(f.name) if c in new else F.col(quote(f.name)) for c, f in fields.items()]
        self._swap(n["table"], both.select(*cols))
        return count

    def _by_row(self, n: Node) -> bool:
        """Whether a change asks of each row only that row: no subquery, no clock, no function of the user's."""
        parts = [n["where"] if n["where"] is not None else [], [v for _, v in n.get("sets") or []]]
        return not any(x.k in QUERY or x.k == "now" or x.k == "call" and x["name"] in self.functions for x in walk(parts))

    def _scoped(self, n: Node, t: Table) -> tuple[str, Renderer, str]:
        """A view of all rows, a renderer, and the condition of the rows that a change meets, true or false."""
        view = f"mr_{self.id}_{n['table'].lower()}__all_{next(_ids)}"
        t.df.createOrReplaceTempView(view)
        r = self._renderer(Node("both", w=n["where"], s=[v for _, v in n.get("sets") or []]))
        test = r.truth(n["where"]) if n["where"] is not None else "TRUE"
        scope = t.updatable if n.k == "update" else t.deletable
        return view, r, " AND ".join([f"COALESCE({test}, FALSE)", *(f"COALESCE(({s}), FALSE)" for s in (scope, t.readable) if s)])

    def _rewritten(self, n: Node, view: str, scoped: str, sql: str) -> int:
        """A change as a projection or filter of the rows: nothing is written or shuffled."""
        count = self.spark.sql(f"SELECT 1 FROM {view} AS {quote(n['table'])} WHERE {scoped}").count()
        self._swap(n["table"], self.spark.sql(sql))
        return count

    def _met(self, n: Node, t: Table) -> tuple[DataFrame, DataFrame]:
        """All rows of a table with numbers, and the numbers of those that a change meets, with new values."""
        every = self._cut(t.df.withColumn("__row", F.monotonically_increasing_id()))
        view, r, scoped = self._scoped(n, replace(t, df=every))
        cols = [f"{r.e(v)} AS __new{i}" for i, (_, v) in enumerate(n.get("sets") or [])]
        return every, self._cut(self.spark.sql(f"SELECT {', '.join(['__row', *cols])} FROM {view} AS {quote(n['table'])} WHERE {scoped}"))

    def _x_delete(self, n: Node) -> int:
        t = self.table(n["table"])
        if self._by_row(n):
            view, _, scoped = self._scoped(n, t)
            return self._rewritten(n, view, scoped, f"SELECT * FROM {view} AS {quote(n['table'])} WHERE NOT ({scoped})")
        every, hit = self._met(n, t)
        self._swap(n["table"], every.join(hit, "__row", "left_anti").drop("__row"))
        return hit.count()

    def _x_create(self, n: Node) -> int:
        if n["name"].lower() in self.tables if n["temp"] else self.exists(n["name"]):
            if n["there"]:
                return 0
            raise SqlError(f"table {n['name']} exists")
        kinds = T.StructType([T.StructField(c, SPARK_TYPES[affinity(k)]) for c, k, _ in n["cols"]])
        at = self if n["temp"] or self.parent is None else self.parent._root()
        r = self._renderer(n)
        at.register(n["name"], self.spark.createDataFrame([], kinds), n["pk"], n["unique"], defaults={c.lower(): r.e(d) for c, _, d in n["cols"] if d is not None})
        return 0

    def _root(self) -> Engine:
        return self.parent._root() if self.parent else self

    def _x_drop(self, n: Node) -> int:
        if n["what"] == "table":
            if not self.exists(n["name"]):
                if n["gone"]:
                    return 0
                raise SqlError(f"no table {n['name']}")
            del self._owner(n["name"]).tables[n["name"].lower()]
        return 0

    def _x_index(self, n: Node) -> int:
        return 0
