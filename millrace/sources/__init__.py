"""Relations from files, rows, generators and databases, with one type per column."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _widened(df: DataFrame) -> DataFrame:
    """Text columns become bigint or double where every value is one; empty text becomes NULL. One pass over all rows."""
    whole, real = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    cols = {c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in df.columns}
    tests = [F.coalesce(F.bool_and(F.trim(x).rlike(p)), F.lit(False)).alias(f"{k}{i}") for i, x in enumerate(cols.values()) for k, p in (("w", whole), ("r", real))]
    got = df.agg(*tests).first() if tests else None
    out = []
    for i, (c, x) in enumerate(cols.items()):
        kind = "bigint" if got[f"w{i}"] else "double" if got[f"r{i}"] else "string"
        out.append((F.trim(x) if kind != "string" else x).cast(kind).alias(c))
    return df.select(*out)


def csv_file(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = "\\") -> DataFrame:
    """A CSV file with a header (trimmed, without byte-order mark); types are inferred over the whole file."""
    df = spark.read.csv(path, header=True, sep=delimiter, quote=quote, escape=escape, multiLine=True, encoding="UTF-8")
    return _widened(df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)))


def csv_text(spark: SparkSession, text: str, delimiter: str = ",", quote: str = '"', escape: str = "\\") -> DataFrame:
    """The same from a string."""
    rows = list(csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=delimiter, quotechar=quote))
    if not rows:
        raise ValueError("CSV without a header")
    head = [h.strip() for h in rows[0]]
    body = [tuple((r + [None] * len(head))[: len(head)]) for r in rows[1:] if r]
    return _widened(spark.createDataFrame(body, T.StructType([T.StructField(h, T.StringType()) for h in head])))


def _flat(df: DataFrame) -> DataFrame:
    """Booleans as 1 and 0, integers as bigint, nested values as JSON text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def json_file(spark: SparkSession, path: str, pointer: str | None = None) -> DataFrame:
    """An array of objects in a JSON file, at a JSON pointer or at the top; missing keys are NULL."""
    df = spark.read.json(path, multiLine=True)
    for step in (pointer or "").strip("/").split("/") if pointer else []:
        df = df.select(F.col(f"`{step}`").alias("x"))
        kind = df.schema[0].dataType
        df = df.select("x.*") if isinstance(kind, T.StructType) else df.select(F.explode("x").alias("x")).select("x.*")
    if not df.columns:
        raise ValueError("JSON without rows")
    return _flat(df)


def json_text(spark: SparkSession, text: str, pointer: str | None = None) -> DataFrame:
    return json_rows(spark, _at(json.loads(text), pointer))


def _at(data: Any, pointer: str | None) -> Any:
    for step in (pointer or "").strip("/").split("/") if pointer else []:
        data = data[int(step)] if isinstance(data, list) else data[step]
    return data


def json_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Objects in memory: the union of their keys, int widening to float to text."""
    if not rows:
        raise ValueError("JSON without rows")
    keys = list(dict.fromkeys(k for r in rows for k in r))
    clean = [{k: int(v) if isinstance(v, bool) else json.dumps(v) if isinstance(v, (dict, list)) else v for k, v in r.items()} for r in rows]
    fields, casts = [], {}
    for k in keys:
        kinds = {type(r.get(k)) for r in clean} - {type(None)}
        kind, cast = (T.LongType(), int) if kinds == {int} else (T.DoubleType(), float) if kinds and kinds <= {int, float} else (T.StringType(), str)
        fields.append(T.StructField(k, kind))
        casts[k] = cast
    data = [tuple(None if r.get(k) is None else casts[k](r[k]) for k in keys) for r in clean]
    return spark.createDataFrame(data, T.StructType(fields))


def rows(spark: SparkSession, data: Iterable, schema: str | T.StructType) -> DataFrame:
    """Rows in memory."""
    return spark.createDataFrame(list(data), schema)


def generator(spark: SparkSession, make: Callable[[], Iterable], schema: str) -> DataFrame:
    """Rows that a function yields, made on an executor each time the relation is read."""
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches):
        import pandas as pd

        for _ in batches:
            pass
        part: list = []
        for row in make():
            part.append(row)
            if len(part) == 10_000:
                yield pd.DataFrame(part, columns=names)
                part = []
        yield pd.DataFrame(part, columns=names)

    return spark.range(0, 1, 1, 1).mapInPandas(run, schema)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database over JDBC; filters on it are pushed down. The driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query of a SQLite file that the executors can reach, without a JDBC driver."""

    def make():
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            yield from con.execute(query)

    return generator(spark, make, schema)


def empty(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.where(F.lit(False))
