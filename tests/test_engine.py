"""Errors, guard rails, changes and the fluent interface, with SQLite as a second opinion."""

import sqlite3

import pytest

from millrace import Bind, Engine, LimitError, Limits, Predicate, SqlError

USERS = [(1, "Alice", 30, 85.5, "First user"), (2, "Bob", 25, 92.0, None), (3, "Charlie", 35, None, ""), (4, "100% pure", None, 70.0, "a_b")]


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.register("users", spark.createDataFrame(USERS, "id long, name string, age long, score double, notes string"), pk=["id"])
    e.register("orders", spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x")], "oid long, id long, name string"))
    return e


@pytest.mark.parametrize("sql", [
    "SELECT t.* FROM nosuch t", "SELECT nosuch FROM users", "SELECT NOSUCH(id) FROM users", "SELECT LOG(id) FROM users",
    "SELECT u.id FROM users u JOIN orders o USING (id)", "SELECT 1 FROM users CROSS JOIN orders ON 1 = 1",
    "SELECT 1 FROM users u NATURAL JOIN (SELECT 1 AS zz) v", "SELECT (1, 2) FROM users", "SELECT DATE '2020-13-01'",
    "SELECT SUM(id) OVER (ORDER BY id) FROM users", "SELECT id FROM users WHERE name LIKE 'a' ESCAPE 'ab'",
    "SELECT id FROM users GROUP BY 9", "SELECT SUBSTR(name) FROM users", "UPDATE users SET id = 1 LIMIT 3", "SELECT ? FROM users",
])
def test_errors(db, sql):
    with pytest.raises(Exception):
        db.sql(sql).collect() if sql.startswith("SELECT") else db.exec(sql)


@pytest.mark.parametrize("sql", [
    "SELECT id FROM users WHERE name LIKE 'a%' OR notes LIKE '%!_%' ESCAPE '!'", "SELECT id FROM users WHERE age NOT IN (25, NULL)",
    "SELECT id FROM users WHERE score IS NOT DISTINCT FROM NULL", "SELECT name FROM users ORDER BY score, id LIMIT 2", "SELECT id, 7 % (id - 1) AS m FROM users",
    "SELECT SUBSTR(name, -3, 2) AS a, SUBSTR(name, 0) AS b FROM users", "SELECT CAST(name AS INTEGER) AS n FROM users", "SELECT name, MAX(age) AS a FROM users",
    "SELECT COUNT(*) AS n FROM users HAVING COUNT(*) > 100", "SELECT id FROM users WHERE EXISTS (SELECT 1 FROM orders WHERE orders.id = users.id)",
    "SELECT id FROM users WHERE (id, age) IN ((1, 30), (4, NULL))", "SELECT id AS k FROM users UNION SELECT oid FROM orders INTERSECT SELECT 3",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 3) % 10 FROM r) SELECT n FROM r", "SELECT TRIM(name, 'Ae') AS t, INSTR(name, 'o') AS i FROM users",
])
def test_same_as_sqlite(db, sql):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE users (id INTEGER, name TEXT, age INTEGER, score REAL, notes TEXT)")
    con.execute("CREATE TABLE orders (oid INTEGER, id INTEGER, name TEXT)")
    con.executemany("INSERT INTO users VALUES (?, ?, ?, ?, ?)", USERS)
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(1, 1, "x"), (2, 1, "y"), (3, 2, "x")])
    assert sorted(map(repr, map(tuple, db.sql(sql).collect()))) == sorted(map(repr, con.execute(sql).fetchall()))


def test_limits(spark, db):
    small = Engine(spark, Limits(joined_tables=2, subquery_depth=1, recursion=20, buffered_writes=2))
    small.tables = dict(db.tables)
    for sql in ("SELECT 1 FROM users a, users b, users c", "SELECT 1 FROM users WHERE id IN (SELECT id FROM orders WHERE oid IN (SELECT 1))", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT n + 1 FROM r) SELECT n FROM r"):
        with pytest.raises(LimitError):
            small.sql(sql).collect()
    with pytest.raises(LimitError):
        small.exec("INSERT INTO orders SELECT id, id, name FROM users")


def test_changes(spark):
    e = Engine(spark)
    e.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER)")
    assert e.exec("INSERT INTO t VALUES (1, 1), (2, 2), (3, 3)") == 3
    assert e.exec("INSERT INTO t SELECT id + 3, n FROM t") == 3
    assert e.exec("UPDATE t SET n = n * 10 WHERE n > :lo", {"lo": 1}) == 4
    assert e.exec("DELETE FROM t WHERE id = 1") == 1
    with pytest.raises(SqlError):
        e.exec("INSERT INTO t VALUES (2, 0)")
    assert e.exec("REPLACE INTO t VALUES (2, 7)") == 1
    assert sorted(map(tuple, e.sql("SELECT id, n FROM t").collect())) == [(2, 7), (3, 30), (4, 1), (5, 20), (6, 30)]
    e.exec("CREATE INDEX i ON t (n)"), e.exec("DROP TABLE t"), e.exec("DROP TABLE IF EXISTS t")
    assert not e.exists("t")


def test_fluent(db):
    q = db.from_table("users")
    assert q.eq("score", None).column() == [3]
    assert q.order("age DESC").limit(3).offset(1).limit(9).columns("id").column() == [1, 2]
    assert q.like("name", "%LI%").count() == 2 and q.in_("id", []).count() == 0 and q.load(2).name == "Bob"
    assert Predicate().gte("age", Bind("a")).bind(a=30).test({"age": 31}) and not Predicate.never().test({})
    with pytest.raises(ValueError):
        q.columns("nosuch")
    with pytest.raises(ValueError):
        Predicate().eq("a", Bind("x")).column()
    assert q.url("age:gte=30&name:like=*l*").count() == 2
    assert q.all().map(lambda r: r.id).reduce(lambda a, b: a + b, 0) == 10


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sql", [
    "SELECT id FROM users WHERE age >= ALL (SELECT oid FROM orders)", "SELECT id FROM users WHERE age < ANY (SELECT oid FROM orders)", "SELECT id FROM users WHERE id = ANY (SELECT oid FROM orders)",
    "SELECT id FROM users WHERE id NOT IN (SELECT oid FROM orders)", "SELECT id FROM users WHERE age <> ALL (SELECT oid FROM orders) AND name <> 'x'",
])
def test_no_nested_loop_over_a_subquery(spark, db, sql):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = db.sql(sql)
        df.collect()
        assert "NestedLoop" not in plan(df) and "Broadcast" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantified_comparisons_with_nulls(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, v long"))
    e.register("s", spark.createDataFrame([(1,), (2,), (None,)], "v long"))
    got = lambda c: sorted(r[0] for r in e.sql(f"SELECT id FROM t WHERE {c}").collect())
    assert got("v >= ALL (SELECT v FROM s)") == [] and got("v >= ALL (SELECT v FROM s WHERE v IS NOT NULL)") == [2]
    assert got("v < ANY (SELECT v FROM s)") == [1] and got("v = ANY (SELECT v FROM s)") == [1, 2]
    assert got("v <> ANY (SELECT v FROM s WHERE v = 1)") == [2] and got("v <> ALL (SELECT v FROM s WHERE v = 1)") == [2]
    assert got("v = ALL (SELECT v FROM s WHERE v = 2)") == [2] and got("v > ALL (SELECT v FROM s WHERE v > 9)") == [1, 2, 3]
    assert got("NOT v = ANY (SELECT v FROM s WHERE v = 1)") == [2, 3] and got("v > ANY (SELECT v FROM s WHERE v > 9)") == []
    assert got("v NOT IN (SELECT v FROM s)") == [] and got("v NOT IN (SELECT v FROM s WHERE v = 1)") == [2] and got("v NOT IN (SELECT v FROM s WHERE v > 9)") == [1, 2, 3]


def test_changes_by_row_need_no_join(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, n long"))
    assert e.exec("UPDATE t SET n = n + 1, id = n WHERE n IS NOT NULL") == 2  # both from the old row
    assert e.exec("DELETE FROM t WHERE n > 2") == 1
    df = e.sql("SELECT id, n FROM t")
    assert sorted(map(tuple, df.collect()), key=repr) == [(1, 2), (3, None)]
    assert "Join" not in plan(df) and "Exchange" not in plan(df)
    assert e.exec("UPDATE t SET n = (SELECT MAX(id) FROM t)") == 2
    assert sorted(map(tuple, e.sql("SELECT id, n FROM t").collect())) == [(1, 3), (3, 3)]


def test_nested_subqueries_that_name_the_outermost_table(spark):
    """Departments all of whose members have ordered each of the department's products."""
    e = Engine(spark)
    e.register("d", spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    e.register("m", spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, dept long"))
    e.register("o", spark.createDataFrame([(10, 1), (11, 1), (12, 1)], "member long, dept long"))
    got = lambda sql: sorted(r[0] for r in e.sql(sql).collect())
    every = "SELECT d.id FROM d WHERE {0} (SELECT 1 FROM m WHERE m.dept = d.id AND {1} (SELECT 1 FROM o WHERE o.member = m.id AND o.dept = d.id))"
    assert got(every.format("NOT EXISTS", "NOT EXISTS")) == [1, 3]
    assert got(every.format("EXISTS", "NOT EXISTS")) == [2]
    assert got(every.format("NOT EXISTS", "EXISTS")) == [2, 3]
    assert got(every.format("EXISTS", "EXISTS")) == [1]


def test_shell(spark, db):
    import io

    from millrace.__main__ import shell

    out = io.StringIO()
    shell(db, io.StringIO("SELECT id, name FROM users\nWHERE id = 1;\nSELECT nosuch FROM users;\nCREATE TABLE shell_t (a INTEGER); INSERT INTO shell_t VALUES (1), (2);\n.tables\nSELECT COUNT(*) AS n FROM shell_t"), out)
    text = out.getvalue()
    assert "Alice" in text and "error:" in text and "2 rows changed" in text and "shell_t" in text and "\n2\n" in text
