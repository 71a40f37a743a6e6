"""A shell: python -m millrace [name=path ...] reads statements that end with ``;`` and prints their rows."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from millrace.operators.engine import Engine
from millrace.plans.parser import parse
from millrace.plans.render import QUERY

#: Rows that are printed of a result.
ROWS = 100


def statements(text: str) -> tuple[list[str], str]:
    """The whole statements of a text, and what is left: a ``;`` inside quotes ends none."""
    out, begin, quote = [], 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            out.append(text[begin:i])
            begin = i + 1
    return out, text[begin:]


def run(engine: Engine, sql: str, out: TextIO) -> None:
    try:
        if parse(sql).k in QUERY:
            df = engine.sql(sql)
            rows = df.limit(ROWS + 1).collect()
            print("\t".join(df.columns), file=out)
            for r in rows[:ROWS]:
                print("\t".join("NULL" if v is None else str(v) for v in r), file=out)
            if len(rows) > ROWS:
                print(f"... the first {ROWS} rows", file=out)
        else:
            print(f"{engine.exec(sql)} rows changed", file=out)
    except Exception as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=out)


def shell(engine: Engine, lines: TextIO, out: TextIO) -> None:
    left = ""
    for line in lines:
        if not left.strip() and line.strip().startswith("."):
            if line.strip() == ".quit":
                return
            print("\n".join(engine.names()) if line.strip() == ".tables" else "commands: .tables .quit", file=out)
            continue
        done, left = statements(left + line)
        for sql in done:
            run(engine, sql, out)
    if left.strip():
        run(engine, left, out)


if __name__ == "__main__":
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    at = Engine(spark)
    for arg in sys.argv[1:]:
        name, path = arg.split("=", 1)
        at.register(name, spark.read.parquet(path))
    shell(at, sys.stdin, sys.stdout)
