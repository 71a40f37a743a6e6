"""One query for each operator of the engine, in its dialect, and the same in DuckDB's SQL."""

from __future__ import annotations

import atexit
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sources
from millrace.operators.engine import Engine, Limits
from millrace.operators.predicate import Bind, Predicate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    for t in TABLES:
        out.register(t, _Lazy(spark, f"{sf_dir}/{t}.parquet"))  # type: ignore[arg-type]
    return out


class _Lazy:
    """A Parquet table that is opened when a query names it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._open = lambda: spark.read.parquet(path)
        self._df: DataFrame | None = None

    def __getattr__(self, name: str):
        if self.__dict__.get("_df") is None:
            self.__dict__["_df"] = self.__dict__["_open"]()
        return getattr(self.__dict__["_df"], name)


FLAGSHIP = """
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, COUNT(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""

#: name -> (SQL of the dialect, DuckDB SQL or None if it is the same)
SQL: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "scan_project": ("SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus FROM orders", None),
    "select_star_expr": ("SELECT *, n_nationkey + 1 AS next_key FROM nation", None),
    "single_row": ("SELECT 1 AS one, 'x' AS x", None),
    "filter_cmp": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F'", None),
    "filter_and_or_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000) AND o_custkey > 10", None),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 5 AND 500", None),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')", None),
    "filter_not_in_list": ("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4, 5)", None),
    "filter_in_list_null": ("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, NULL)", None),
    "filter_in_empty": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN ()", "SELECT n_nationkey FROM nation"),
    "filter_like_ci": ("SELECT n_name FROM nation WHERE n_name LIKE 'nat%1_'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nat%1_'"),
    "filter_like_escape": ("SELECT doc_id FROM documents WHERE text LIKE '%100!%%' ESCAPE '!' OR lang LIKE 'D!e' ESCAPE '!'", "SELECT doc_id FROM documents WHERE contains(text, '100%') OR lang ILIKE 'de'"),
    "filter_is_null": ("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL", None),
    "filter_truthy": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "is_distinct_from": ("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULLIF(o_orderpriority, o_orderpriority) OR o_orderstatus IS DISTINCT FROM 'O'", None),
    "row_value_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) = ('R', 'F')", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"),
    "row_value_lt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_quantity) < ('N', 10)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag < 'N' OR (l_returnflag = 'N' AND l_quantity < 10)"),
    "row_value_in": ("SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 99))", "SELECT n_name FROM nation WHERE (n_regionkey = 0 AND n_nationkey = 0) OR (n_regionkey = 1 AND n_nationkey = 1)"),
    "row_value_in_query": ("SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, r_regionkey FROM region)", "SELECT n_name FROM nation WHERE n_regionkey = n_nationkey AND n_regionkey IN (SELECT r_regionkey FROM region)"),
    "arith_div_mod": ("SELECT o_orderkey, o_totalprice / (o_custkey % 3) AS q, MOD(o_custkey, o_orderkey % 4) AS m, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) AS q, o_custkey % nullif(o_orderkey % 4, 0) AS m, o_custkey % 7 AS r FROM orders"),
    "concat_op": ("SELECT n_nationkey, n_name || '-' || n_regionkey AS s, NULLIF(n_name, n_name) || 'x' AS z FROM nation", "SELECT n_nationkey, n_name || '-' || n_regionkey::VARCHAR AS s, NULL::VARCHAR AS z FROM nation"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS size FROM orders", None),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders", None),
    "cast_affinity": ("SELECT n_nationkey, CAST(n_nationkey || 'abc' AS INTEGER) AS i, CAST(n_name AS INTEGER) AS z, CAST(n_nationkey AS TEXT) AS t, CAST(1.7 AS INTEGER) AS trunced, CAST(' 2.5e1x' AS REAL) AS f FROM nation", "SELECT n_nationkey, n_nationkey::BIGINT AS i, 0::BIGINT AS z, n_nationkey::VARCHAR AS t, 1::BIGINT AS trunced, 25.0::DOUBLE AS f FROM nation"),
    "fn_string": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, LENGTH(n_name) AS n, CHAR_LENGTH(n_name) AS c, CONCAT(n_name, NULL, '!') AS k, REPLACE(n_name, 'A', 'xx') AS r, REVERSE(n_name) AS v, REPEAT(n_name, 2) AS p FROM nation", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, strlen(n_name) AS n, length(n_name) AS c, concat(n_name, NULL, '!') AS k, replace(n_name, 'A', 'xx') AS r, reverse(n_name) AS v, repeat(n_name, 2) AS p FROM nation"),
    "fn_bytes": ("SELECT doc_id, LENGTH(text) AS n, OCTET_LENGTH(text) AS o, CHARACTER_LENGTH(text) AS c FROM documents", "SELECT doc_id, strlen(text) AS n, strlen(text) AS o, length(text) AS c FROM documents"),
    "fn_trim_pad": ("SELECT n_nationkey, TRIM('  ' || n_name || ' ') AS t, LTRIM(n_name, 'AEIOU') AS l, RTRIM(n_name, 'AEIOU') AS r, LPAD(n_name, 12, '*') AS p, RPAD(n_name, 3) AS q, TRIM(BOTH 'A' FROM n_name) AS b FROM nation", "SELECT n_nationkey, trim(n_name) AS t, ltrim(n_name, 'AEIOU') AS l, rtrim(n_name, 'AEIOU') AS r, lpad(n_name, 12, '*') AS p, rpad(n_name, 3, ' ') AS q, trim(n_name, 'A') AS b FROM nation"),
    "fn_substr_edge": ("SELECT n_nationkey, SUBSTR(n_name, 0, 2) AS a, SUBSTR(n_name, -3) AS b, SUBSTR(n_name, 3, -2) AS c, SUBSTRING(n_name FROM 2 FOR 3) AS d, SUBSTR(n_name, 2) AS e FROM nation", "SELECT n_nationkey, substr(n_name, 0, 2) AS a, substr(n_name, -3) AS b, substr(n_name, 3, -2) AS c, substring(n_name, 2, 3) AS d, substr(n_name, 2) AS e FROM nation"),
    "fn_position_instr": ("SELECT n_nationkey, INSTR(n_name, 'A') AS i, POSITION('IN' IN n_name) AS p FROM nation", "SELECT n_nationkey, instr(n_name, 'A') AS i, instr(n_name, 'IN') AS p FROM nation"),
    "fn_numeric": ("SELECT c_custkey, ABS(c_acctbal) AS a, ROUND(c_acctbal, 1) AS r, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, SIGN(c_acctbal) AS s, ROUND(SQRT(c_acctbal), 6) AS q, ROUND(LN(c_acctbal), 6) AS l, POWER(c_nationkey, 2) AS p, ROUND(EXP(c_nationkey), 3) AS e FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, sign(c_acctbal)::INTEGER AS s, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS q, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS l, power(c_nationkey, 2) AS p, round(exp(c_nationkey), 3) AS e FROM customer"),
    "fn_null": ("SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS c, IFNULL(NULLIF(o_custkey, 1), 0) AS i, NVL(NULL, 'n') AS v FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, ifnull(nullif(o_custkey, 1), 0) AS i, 'n' AS v FROM orders"),
    "extract_fields": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events"),
    "datetime_literal_filter": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'", None),
    "count_distinct": ("SELECT COUNT(DISTINCT l_returnflag) AS f, COUNT(DISTINCT l_suppkey) AS s, COUNT(*) AS n, ROUND(SUM(DISTINCT l_quantity), 2) AS q, ROUND(AVG(DISTINCT l_discount), 6) AS d FROM lineitem", None),
    "agg_global": ("SELECT COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, ROUND(AVG(o_totalprice), 2) AS a, ROUND(SUM(ALL o_totalprice), 2) AS s FROM orders", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 2) AS a, round(sum(o_totalprice), 2) AS s FROM orders"),
    "agg_empty_input": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", None),
    "groupby_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "groupby_ordinal": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1", None),
    "groupby_alias": ("SELECT UPPER(o_orderstatus) AS st, COUNT(*) AS n FROM orders GROUP BY st", None),
    "groupby_expr": ("SELECT o_custkey % 5 AS g, COUNT(*) AS n FROM orders GROUP BY o_custkey % 5", None),
    "groupby_no_agg": ("SELECT n_regionkey FROM nation GROUP BY n_regionkey", None),
    "having_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", None),
    "having_unprojected": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 1500000", None),
    "having_no_groupby": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10", None),
    "agg_in_expr": ("SELECT o_orderstatus, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS k, ROUND(MAX(o_totalprice) - MIN(o_totalprice), 2) AS d FROM orders GROUP BY o_orderstatus", None),
    "order_by_unprojected_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 7", None),
    "bare_column_max": ("SELECT o_orderkey, MAX(o_totalprice) AS hi FROM orders", "SELECT max_by(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS hi FROM orders"),
    "bare_column_min": ("SELECT o_orderstatus, o_orderkey AS k, MIN(o_totalprice) AS lo FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, min_by(o_orderkey, o_totalprice) AS k, min(o_totalprice) AS lo FROM orders GROUP BY o_orderstatus"),
    "distinct_over_groups": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) < 20", None),
    "order_nulls": ("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY st, o_orderkey LIMIT 20", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders ORDER BY st NULLS FIRST, o_orderkey LIMIT 20"),
    "order_nulls_last": ("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS st FROM orders ORDER BY st ASC NULLS LAST, o_orderkey DESC LIMIT 20", None),
    "order_expr_limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey % 10 DESC, o_orderkey LIMIT 10", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", None),
    "fetch_first": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 3 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 3"),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "inner_join": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", None),
    "join_range": ("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey >= n_nationkey AND s_nationkey <= n_nationkey + 2", None),
    "left_join": ("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey", None),
    "left_anti": ("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL", None),
    "right_join": ("SELECT l_linenumber, o_orderkey FROM lineitem RIGHT OUTER JOIN orders ON l_orderkey = o_orderkey", None),
    "full_join": ("SELECT a.n_name AS x, b.n_name AS y FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey", None),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "comma_join": ("SELECT o_orderkey, c_name, n_name FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey", None),
    "using_join": ("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)", None),
    "natural_join": ("SELECT doc_id, lang, toxic FROM documents NATURAL JOIN labels", None),
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey", None),
    "multi_join_5": ("SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region", None),
    "intersect_all": ("SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_all": ("SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_regionkey FROM nation", None),
    "setop_precedence": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region INTERSECT SELECT n_regionkey FROM nation", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT n_regionkey FROM nation"),
    "setop_order_limit": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 5 OFFSET 1", None),
    "setop_mixed_types": ("SELECT n_name AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_name AS k FROM nation UNION ALL SELECT r_regionkey::VARCHAR FROM region"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders)", None),
    "correlated_scalar": ("SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", None),
    "not_in_subquery_nulls": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)", None),
    "exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "not_exists": ("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", None),
    "exists_two_levels": ("SELECT c.c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey % 25 = c.c_nationkey))", None),
    "gt_all": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'P')"),
    "gt_any": ("SELECT n_nationkey FROM nation WHERE n_nationkey > ANY (SELECT r_regionkey + 10 FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey > (SELECT min(r_regionkey + 10) FROM region)"),
    "derived_table": ("SELECT t.k, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 10", None),
    "derived_column_list": ("SELECT v.a, v.b FROM (SELECT r_regionkey, r_name FROM region) AS v(a, b)", None),
    "values_ctor": ("SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(column1, column2)"),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT k, t FROM a WHERE t > 1000000) SELECT k, ROUND(t, 2) AS t FROM b", None),
    "cte_column_list": ("WITH a(x, y) AS (SELECT r_regionkey, r_name FROM region) SELECT x, y FROM a", None),
    "cte_shadowing": ("WITH region AS (SELECT n_nationkey AS k FROM nation) SELECT k FROM region", None),
    "recursive_union_all": ("WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 150) SELECT n FROM s", None),
    "recursive_union_cycle": ("WITH RECURSIVE r(k) AS (SELECT 3 UNION SELECT (k * 2) % 7 FROM r) SELECT k FROM r", "WITH RECURSIVE r(k) AS (SELECT 3 UNION SELECT (k * 2) % 7 FROM r) SELECT k::BIGINT AS k FROM r"),
    "window_row_number": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders", None),
    "window_rank_dense": ("SELECT n_nationkey, RANK() OVER (ORDER BY n_regionkey) AS r, DENSE_RANK() OVER (ORDER BY n_regionkey DESC) AS d, RANK() OVER () AS one FROM nation", None),
    "window_over_groupby": ("SELECT o_orderstatus, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_orderstatus", None),
    "star_of_table": ("SELECT o.*, c.c_name AS who FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'", None),
    "windows_several": ("SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS a, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC) AS b, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS c FROM orders", None),
    "distinct_after_window": ("SELECT DISTINCT DENSE_RANK() OVER (ORDER BY n_regionkey) AS r FROM nation", None),
    "current_datetime": ("SELECT LENGTH(CURRENT_DATE) AS d, LENGTH(CURRENT_TIME) AS t, LENGTH(CURRENT_TIMESTAMP) AS ts, CURRENT_DATE > '2020-01-01' AS late", "SELECT 10::BIGINT AS d, 8::BIGINT AS t, 19::BIGINT AS ts, TRUE AS late"),
    "filter_bare_text": ("SELECT r_name FROM region WHERE 'abc'", "SELECT r_name FROM region"),
    "bare_star_max": ("SELECT MAX(o_orderkey) AS hi, * FROM orders", "SELECT o_orderkey AS hi, * FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)"),
    "bare_columns_one_row": ("SELECT n_regionkey, n_nationkey, n_name, COUNT(*) AS n, MAX(n_nationkey) AS hi FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, min(n_nationkey) AS n_nationkey, min_by(n_name, n_nationkey) AS n_name, count(*) AS n, max(n_nationkey) AS hi FROM nation GROUP BY n_regionkey"),
    "concat_precedence": ("SELECT 2 * 3 || 4 AS s, 5 + 1 || 8 AS t", "SELECT 68::DOUBLE AS s, 23::DOUBLE AS t"),
    "fn_instr_bytes": ("SELECT doc_id, INSTR(text, 'ti') AS i, POSITION('zz~' IN text) AS z, INSTR('Åsa' || lang, 'a') AS a FROM documents", "SELECT doc_id, CASE WHEN instr(text, 'ti') = 0 THEN 0 ELSE strlen(left(text, instr(text, 'ti') - 1)) + 1 END AS i, instr(text, 'zz~') AS z, CASE WHEN lang IS NOT NULL THEN 4::BIGINT END AS a FROM documents"),
    "fn_upper_ascii": ("SELECT doc_id, UPPER(SUBSTR(text, 1, 60)) AS u, LOWER(SUBSTR(text, 1, 60)) AS l FROM documents", "SELECT doc_id, translate(text[1:60], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, translate(text[1:60], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM documents"),
    "fn_trim_range": ("SELECT n_nationkey, TRIM(n_name, 'A..N0..3') AS t, RTRIM(n_name, '0..9') AS r FROM nation", "SELECT n_nationkey, trim(n_name, 'ABCDEFGHIJKLMN0123') AS t, rtrim(n_name, '0123456789') AS r FROM nation"),
    "fn_round_column": ("SELECT c_custkey, ROUND(c_acctbal / 7, c_custkey % 3) + 0.0 AS r, ROUND(c_acctbal, -2) + 0.0 AS h FROM customer", "SELECT c_custkey, round(c_acctbal / 7, (c_custkey % 3)::INTEGER) + 0.0::DOUBLE AS r, round(c_acctbal, -2) + 0.0::DOUBLE AS h FROM customer"),
    "lt_any_text": ("SELECT n_name FROM nation WHERE n_name < ANY (SELECT 'NATION_2' FROM region) AND n_name <> ALL (SELECT 'NATION_1' || r_regionkey FROM region)", "SELECT n_name FROM nation WHERE n_name < 'NATION_2' AND n_name NOT IN (SELECT 'NATION_1' || r_regionkey FROM region)"),
    "quantified_nulls": ("SELECT n_nationkey FROM nation WHERE n_nationkey >= ALL (SELECT NULLIF(r_regionkey, 1) FROM region) OR n_nationkey = ANY (SELECT NULLIF(r_regionkey, 1) FROM region) OR n_nationkey < ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99 AND n_nationkey = 24)", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (0, 2, 3, 4) OR TRUE"),
    "quantified_correlated": ("SELECT c_custkey FROM customer c WHERE c.c_acctbal * 50 > ALL (SELECT o.o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer c WHERE coalesce(c.c_acctbal * 50 > (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey), NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))"),
    "not_exists_two_levels": ("SELECT s.s_suppkey AS k FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey <= s.s_nationkey AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > s.s_nationkey))", None),
    "exists_not_exists_deep": ("SELECT c.c_custkey AS k FROM customer c WHERE c.c_nationkey < 10 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey NOT IN (SELECT l.l_orderkey FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey % 25 <> c.c_nationkey))", None),
    "recursive_long": ("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 101 FROM r) SELECT k FROM r", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 101 FROM r) SELECT k::BIGINT AS k FROM r"),
    "doc_stats": ("SELECT lang, source, COUNT(*) AS n, MAX(n_chars) AS longest FROM documents GROUP BY lang, source", None),
}


def _builder_chain(spark, d):
    return engine(spark, d).from_table("orders").eq("o_orderstatus", "F").gte("o_totalprice", 100000).order("o_orderkey DESC").columns("o_orderkey", "o_totalprice").limit(50).offset(10).df


def _builder_barrier(spark, d):
    return engine(spark, d).from_table("orders").order("o_orderkey").limit(100).gt("o_totalprice", 150000).columns("o_orderkey").df


def _builder_or(spark, d):
    p = Predicate()
    return engine(spark, d).from_table("orders").or_(p.eq("o_orderstatus", "P"), p.gt("o_totalprice", Bind("x")).lt("o_orderkey", 500).bind(x=300000)).columns("o_orderkey").df


def _builder_union_except(spark, d):
    q = engine(spark, d).from_table("nation").columns("n_regionkey")
    return q.union(q.limit(3)).except_(engine(spark, d).query("SELECT r_regionkey AS n_regionkey FROM region WHERE r_regionkey > 2")).df


def _builder_url_filter(spark, d):
    return engine(spark, d).from_table("nation").url("n_name:like=*on*1*&n_regionkey:gte=1", ["n_name", "n_regionkey"]).columns("n_name").df


def _builder_select_where(spark, d):
    return engine(spark, d).from_table("customer").where("c_acctbal > ? AND c_mktsegment LIKE :seg" .replace(":seg", "?"), [1000, "b%"]).select("c_custkey, UPPER(c_name) AS name").df


def _builder_in_query(spark, d):
    e = engine(spark, d)
    return e.from_table("customer").in_("c_custkey", e.query("SELECT o_custkey FROM orders WHERE o_totalprice > 250000")).columns("c_custkey").df


def _udf_scalar(spark, d):
    e = engine(spark, d)
    e.create_function("initials", lambda s: None if s is None else "".join(w[0] for w in s.split()), "string", 1)
    return e.sql("SELECT n_nationkey, INITIALS(n_name) AS i FROM nation")


def _udaf_custom(spark, d):
    e = engine(spark, d)
    e.create_aggregate("sumsq", lambda s, v: s + (v or 0) ** 2, float, "double", lambda: 0.0)
    return e.sql("SELECT n_regionkey, SUMSQ(n_nationkey) AS q FROM nation GROUP BY n_regionkey")


def _own(spark, d) -> Engine:
    e = engine(spark, d)
    e.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, v REAL, s TEXT DEFAULT 'none')")
    e.exec("INSERT INTO t (id, v) SELECT n_nationkey, n_regionkey * 1.5 FROM nation")
    return e


def _dml_insert_select(spark, d):
    e = _own(spark, d)
    e.exec("INSERT INTO t SELECT id + 100, v, 'copy' FROM t WHERE id < 5")
    return e.sql("SELECT id, v, s FROM t")


def _dml_update(spark, d):
    e = _own(spark, d)
    e.exec("UPDATE t SET v = v + id, s = 'even' WHERE id % 2 = 0")
    return e.sql("SELECT id, v, s FROM t")


def _dml_delete(spark, d):
    e = _own(spark, d)
    e.exec("DELETE FROM t WHERE v > ? OR id = 0", [4])
    return e.sql("SELECT id, v, s FROM t")


def _dml_replace(spark, d):
    e = _own(spark, d)
    e.exec("REPLACE INTO t VALUES (1, 9.5, 'new'), (77, 0.5, 'more')")
    return e.sql("SELECT id, v, s FROM t")


def _row_scope(spark, d):
    e = engine(spark, d)
    e.register("mine", spark.read.parquet(f"{d}/nation.parquet").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), readable="n_regionkey < 3", updatable="n_regionkey = 1", deletable="n_regionkey = 2")
    e.exec("UPDATE mine SET n_name = 'X'")
    e.exec("DELETE FROM mine")
    return e.sql("SELECT n_nationkey, n_name FROM mine")


def _shadowing(spark, d):
    e = engine(spark, d)
    return e.with_tables({"region": spark.createDataFrame([(1, "HERE")], "r_regionkey int, r_name string")}).sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _session_temp(spark, d):
    s = engine(spark, d).session()
    s.exec("CREATE TEMPORARY TABLE region (r_regionkey INTEGER, r_name TEXT)")
    s.exec("INSERT INTO region VALUES (2, 'PRIVATE')")
    return s.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _federated(spark, d):
    e = engine(spark, d)
    e.register("c", sources.csv_text(spark, "id, name ,score\n1,Ann,1.5\n2,Bob,\n3,Cyd,7\n"))
    e.register("j", sources.json_text(spark, '{"data": {"rows": [{"id": 1, "ok": true}, {"id": 2, "ok": false, "tags": ["x"]}, {"id": 4}]}}', "/data/rows"))
    e.register("g", sources.generator(spark, lambda: ((i, i * i) for i in range(5)), "id long, sq long"))
    return e.sql("SELECT c.id AS id, c.name AS name, c.score AS score, j.ok AS ok, g.sq AS sq, n.n_name AS n_name FROM c LEFT JOIN j ON c.id = j.id JOIN g ON g.id = c.id JOIN nation n ON n.n_nationkey = c.id")


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _folder(e: Engine) -> str:
    """A fresh folder that all executors share (of this machine where the session names none and is local)."""
    e._cut(e.spark.range(1))
    return f"{e.spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _csv_file(spark, d):
    e = engine(spark, d)
    path = _folder(e)
    e.sql("SELECT n_nationkey, n_name, n_regionkey / 2 AS half, NULLIF(n_regionkey, 1) AS maybe FROM nation").write.csv(path, header=True, quoteAll=True)
    e.register("f", sources.csv_file(spark, path))
    return e.sql("SELECT n_nationkey, n_name, half, maybe FROM f")


def _json_file(spark, d):
    e = engine(spark, d)
    path = _folder(e)
    rows = F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") > 2).alias("far")))
    spark.read.parquet(f"{d}/region.parquet").agg(F.to_json(F.struct(F.struct(rows.alias("rows")).alias("data"))).alias("value")).write.text(path)
    e.register("f", sources.json_file(spark, path, "/data/rows"))
    return e.sql("SELECT id, name, far FROM f")


def _memory_and_empty(spark, d):
    e = engine(spark, d)
    e.register("m", sources.rows(spark, [(0, "zero"), (3, None)], "k int, word string"))
    e.register("nothing", sources.empty(e.table("region").df.select("r_regionkey")))
    return e.sql("SELECT n_name, word, r_regionkey FROM nation JOIN m ON n_regionkey = k LEFT JOIN nothing ON r_regionkey = k")


def _sqlite_table(spark, d):
    """A SQLite file lies on this machine, so the executors must too."""
    folder = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with sqlite3.connect(f"{folder}/t.db") as con:
        con.execute("CREATE TABLE t (id INTEGER, word TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"w{i}") for i in range(8)])
    e = engine(spark, d)
    e.register("t", sources.sqlite(spark, f"{folder}/t.db", "SELECT id, word FROM t WHERE id > 1", "id long, word string"))
    return e.sql("SELECT word, n_name FROM t JOIN nation ON n_nationkey = id")


def _view(spark, d):
    e = engine(spark, d)
    e.register("big", e.sql("SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey"))
    return e.sql("SELECT o_custkey, ROUND(t, 2) AS t FROM big WHERE t > 2000000")


def _catalog(spark, d):
    e = Engine(spark).register("nation", spark.read.parquet(f"{d}/nation.parquet"), pk=["n_nationkey"])
    e.exec("CREATE TABLE t (id INTEGER PRIMARY KEY, v REAL)")
    return e.schema()


def _results(spark, d):
    """What the result methods give, a row each."""
    e = engine(spark, d)
    q = e.from_table("region").order("r_regionkey DESC")
    Named = type("Named", (), {"__init__": lambda self, **c: self.__dict__.update(c)})
    out = {
        "one": e.one("SELECT r_name FROM region ORDER BY r_regionkey")[0],
        "value": e.value("SELECT COUNT(*) FROM nation"),
        "column": ",".join(e.column("SELECT r_name FROM region ORDER BY r_name")),
        "all": len(q.limit(3).all()),
        "first": q.first()["r_name"],
        "field": q.columns("r_name").field(),
        "count": q.count(),
        "count page": q.offset(2).count(),
        "exists": q.eq("r_regionkey", 77).exists(),
        "map": ",".join(q.map(lambda r: r["r_name"][0])),
        "hydrate": q.hydrate(Named).first().r_name,
        "json": q.limit(1).json(),
        "iterate": sum(r["r_regionkey"] for r in q),
        "property": q.with_property("note", "x").limit(1).get_property("note"),
    }
    return _frame(spark, [(k, str(v)) for k, v in out.items()], "what string, got string")


def _load_has(spark, d):
    e = Engine(spark).register("nation", spark.read.parquet(f"{d}/nation.parquet"), pk=["n_nationkey"])
    q = e.from_table("nation")
    out = {"load": q.load(7)["n_name"], "gone": q.load(700), "has": q.has({"n_name": "NATION_3", "n_regionkey": 3}), "has not": q.has({"n_name": "NATION_3", "n_regionkey": 0}), "table": e.exists("NATION"), "no table": e.exists("nope")}
    return _frame(spark, [(k, str(v)) for k, v in out.items()], "what string, got string")


def _errors(spark, d):
    """Guard rails and mistakes, and whether each is an error."""
    e = engine(spark, d)
    small = Engine(spark, Limits(subquery_depth=1, recursion=5, buffered_writes=3))
    small.tables = dict(e.tables)
    small.exec("CREATE TABLE w (id INTEGER PRIMARY KEY)")
    tries = {
        "nine tables": lambda: e.sql("SELECT 1 FROM " + ", ".join(f"region r{i}" for i in range(9))),
        "eight tables": lambda: e.sql("SELECT 1 FROM " + ", ".join(f"region r{i}" for i in range(8))),
        "depth": lambda: small.sql("SELECT 1 FROM region WHERE r_regionkey IN (SELECT 1 FROM nation WHERE n_nationkey IN (SELECT 1))"),
        "recursion": lambda: small.sql("WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT k + 1 FROM r) SELECT k FROM r"),
        "buffered writes": lambda: small.exec("INSERT INTO w SELECT n_nationkey FROM nation"),
        "duplicate key": lambda: small.exec("INSERT INTO w VALUES (1), (1)"),
        "no function": lambda: e.sql("SELECT NOSUCH(1)"),
        "no column": lambda: e.sql("SELECT nosuch FROM region"),
        "no table": lambda: e.sql("SELECT 1 FROM nosuch"),
        "a change as a query": lambda: e.sql("DELETE FROM region"),
        "a query as a change": lambda: e.exec("SELECT 1"),
        "never": lambda: e.from_table("region").matching(Predicate.never()).exists() and 1 / 0,
    }

    def fails(run: Callable) -> bool:
        try:
            run()
        except Exception:
            return True
        return False

    return _frame(spark, [(k, fails(f)) for k, f in tries.items()], "what string, error boolean")


def _timeout(spark, d):
    """A query over its time is cancelled, one within it is not."""
    e = engine(spark, d)
    with e.query_timeout(60):
        n = e.value("SELECT COUNT(*) FROM region")
    try:
        with e.query_timeout(0.2):
            spark.range(0, 10**12, 1, 4).selectExpr("sum(sqrt(id)) s").collect()
        late = "done"
    except Exception:
        late = "cancelled"
    return _frame(spark, [(n, late)], "n long, late string")


def _predicates(spark, d):
    p = Predicate().gte("n_regionkey", Bind("low")).like("n_name", "%_1%")
    both = p.bind(low=2)
    rows = [(r["n_name"], both.test(r)) for r in engine(spark, d).from_table("nation").all()]
    return _frame(spark, rows, "n_name string, holds boolean")


def _template(spark, d):
    t = engine(spark, d).from_table("orders").template().gte("o_totalprice", Bind("low")).eq("o_orderstatus", Bind("state")).order("o_orderkey").limit(20).columns("o_orderkey")
    return t.bind(low=300000).bind(state="F").query.df


def _with_cte(spark, d):
    e = engine(spark, d)
    rich = e.query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
    q = e.from_table("orders").with_cte("rich", rich).with_cte("odd", e.query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 1"))
    return q.where("o_custkey IN (SELECT c_custkey FROM rich) AND o_orderkey % 25 IN (SELECT k FROM odd)").columns("o_orderkey").df


def _query_ctes(spark, d):
    e = engine(spark, d)
    return e.query("SELECT n_name, r.r_name AS r_name FROM nation JOIN r ON n_regionkey = r.r_regionkey", ctes={"r": e.from_table("region").gt("r_regionkey", 2)}).df


def _rename(spark, d):
    return engine(spark, d).from_table("region").rename("x", {"r_regionkey": "id"}).select("id, r_name AS name").df


def _plain_pages(spark, d):
    return engine(spark, d).from_table("nation", pages=False).order("n_nationkey").limit(3).limit(9).offset(4).offset(2).columns("n_nationkey").df


def _dml_rest(spark, d):
    """INSERT VALUES, a transaction, an index, DROP, and what each change returns."""
    e = _own(spark, d)
    n = [e.exec("INSERT INTO t (id, v) VALUES (900, 1.5), (901, NULL)"), e.exec("UPDATE t SET v = 7 WHERE id >= 900"), e.exec("DELETE FROM t WHERE id < 5")]
    e.transaction(lambda x: x.exec("INSERT INTO t VALUES (902, 2, 'in')"))
    e.exec("CREATE INDEX at_v ON t (v)")
    e.exec("CREATE TABLE u (id INTEGER)")
    e.exec("DROP TABLE u")
    n += [int(e.exists("u")), int(e.is_aggregate("sum")), int(e.is_aggregate("upper"))]
    return e.sql("SELECT id, v, s FROM t WHERE id >= 900").unionByName(_frame(spark, [(i, float(x), "count") for i, x in enumerate(n)], "id long, v double, s string"))


def _dml_update_subquery(spark, d):
    e = _own(spark, d)
    e.exec("UPDATE t SET v = (SELECT MAX(id) FROM t) WHERE id IN (SELECT r_regionkey FROM region)")
    e.exec("DELETE FROM t WHERE id > (SELECT AVG(id) FROM t)")
    return e.sql("SELECT id, v, s FROM t")


FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "builder_chain": (_builder_chain, "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_orderkey DESC LIMIT 40 OFFSET 10)"),
    "builder_barrier": (_builder_barrier, "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_totalprice > 150000"),
    "builder_or": (_builder_or, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderkey < 500)"),
    "builder_union_except": (_builder_union_except, "SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)"),
    "builder_url_filter": (_builder_url_filter, "SELECT n_name FROM nation WHERE n_name ILIKE '%on%1%' AND n_regionkey >= 1"),
    "builder_select_where": (_builder_select_where, "SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment ILIKE 'b%'"),
    "builder_in_query": (_builder_in_query, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)"),
    "udf_scalar": (_udf_scalar, "SELECT n_nationkey, array_to_string([w[1] for w in string_split(n_name, ' ') if w <> ''], '') AS i FROM nation"),
    "udaf_custom": (_udaf_custom, "SELECT n_regionkey, sum(n_nationkey * n_nationkey)::DOUBLE AS q FROM nation GROUP BY n_regionkey"),
    "dml_insert_select": (_dml_insert_select, "WITH t AS (SELECT n_nationkey::BIGINT AS id, n_regionkey * 1.5::DOUBLE AS v, 'none' AS s FROM nation) SELECT * FROM t UNION ALL SELECT id + 100, v, 'copy' FROM t WHERE id < 5"),
    "dml_update": (_dml_update, "SELECT n_nationkey::BIGINT AS id, n_regionkey * 1.5::DOUBLE + CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END AS v, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'none' END AS s FROM nation"),
    "dml_delete": (_dml_delete, "SELECT n_nationkey::BIGINT AS id, n_regionkey * 1.5::DOUBLE AS v, 'none' AS s FROM nation WHERE NOT (n_regionkey * 1.5 > 4 OR n_nationkey = 0)"),
    "dml_replace": (_dml_replace, "SELECT n_nationkey::BIGINT AS id, n_regionkey * 1.5::DOUBLE AS v, 'none' AS s FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT 1, 9.5, 'new' UNION ALL SELECT 77, 0.5, 'more'"),
    "row_scope": (_row_scope, "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name FROM nation WHERE n_regionkey < 2"),
    "shadowing": (_shadowing, "SELECT n_name, 'HERE' AS r_name FROM nation WHERE n_regionkey = 1"),
    "session_temp": (_session_temp, "SELECT n_name, 'PRIVATE' AS r_name FROM nation WHERE n_regionkey = 2"),
    "csv_file": (_csv_file, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey / 2 AS half, nullif(n_regionkey, 1)::BIGINT AS maybe FROM nation"),
    "json_file": (_json_file, "SELECT r_regionkey::BIGINT AS id, r_name AS name, (r_regionkey > 2)::BIGINT AS far FROM region"),
    "memory_and_empty": (_memory_and_empty, "SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'zero' END AS word, NULL::INTEGER AS r_regionkey FROM nation WHERE n_regionkey IN (0, 3)"),
    "sqlite_table": (_sqlite_table, "SELECT 'w' || n_nationkey AS word, n_name FROM nation WHERE n_nationkey BETWEEN 2 AND 7"),
    "view_as_table": (_view, "SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000"),
    "catalog_schema": (_catalog, "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int', 0, TRUE), ('nation', 'n_name', 'string', 1, FALSE), ('nation', 'n_regionkey', 'int', 2, FALSE), ('t', 'id', 'bigint', 0, TRUE), ('t', 'v', 'double', 1, FALSE)) AS v(table_name, name, type, ordinal, is_key)"),
    "results": (_results, """SELECT * FROM (VALUES ('one', 'AFRICA'), ('value', '25'), ('column', 'AFRICA,AMERICA,ASIA,EUROPE,MIDDLE EAST'), ('all', '3'), ('first', 'MIDDLE EAST'), ('field', 'MIDDLE EAST'), ('count', '5'), ('count page', '3'), ('exists', 'False'), ('map', 'M,E,A,A,A'), ('hydrate', 'MIDDLE EAST'), ('json', '[{"r_regionkey": 4, "r_name": "MIDDLE EAST"}]'), ('iterate', '10'), ('property', 'x')) AS v(what, got)"""),
    "load_has_exists": (_load_has, "SELECT * FROM (VALUES ('load', 'NATION_7'), ('gone', 'None'), ('has', 'True'), ('has not', 'False'), ('table', 'True'), ('no table', 'False')) AS v(what, got)"),
    "guard_rails": (_errors, "SELECT * FROM (VALUES ('nine tables', TRUE), ('eight tables', FALSE), ('depth', TRUE), ('recursion', TRUE), ('buffered writes', TRUE), ('duplicate key', TRUE), ('no function', TRUE), ('no column', TRUE), ('no table', TRUE), ('a change as a query', TRUE), ('a query as a change', TRUE), ('never', FALSE)) AS v(what, error)"),
    "query_timeout": (_timeout, "SELECT 5::BIGINT AS n, 'cancelled' AS late"),
    "predicate_test": (_predicates, "SELECT n_name, n_regionkey >= 2 AND n_name ILIKE '%_1%' AS holds FROM nation"),
    "bind_template": (_template, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20"),
    "builder_with_cte": (_with_cte, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_orderkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1)"),
    "query_with_ctes": (_query_ctes, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 2"),
    "builder_rename": (_rename, "SELECT r_regionkey AS id, r_name AS name FROM region"),
    "plain_pages": (_plain_pages, "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 9 OFFSET 2"),
    "dml_rest": (_dml_rest, "SELECT * FROM (VALUES (900::BIGINT, 7.0::DOUBLE, 'none'), (901, 7, 'none'), (902, 2, 'in'), (0, 2, 'count'), (1, 2, 'count'), (2, 5, 'count'), (3, 0, 'count'), (4, 1, 'count'), (5, 0, 'count')) AS v(id, v, s)"),
    "dml_with_subqueries": (_dml_update_subquery, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey < 5 THEN 24.0 ELSE n_regionkey * 1.5 END::DOUBLE AS v, 'none' AS s FROM nation WHERE n_nationkey <= 12"),
    "federated_csv_json_parquet": (_federated, "SELECT v.*, n_name FROM (VALUES (1::BIGINT, 'Ann', 1.5::DOUBLE, 1::BIGINT, 1::BIGINT), (2, 'Bob', NULL, 0, 4), (3, 'Cyd', 7, NULL, 9)) AS v(id, name, score, ok, sq) JOIN nation ON n_nationkey = id"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: (lambda spark, d, q=q: engine(spark, d).sql(q)) for n, (q, _) in SQL.items()}
    return out | {n: f for n, (f, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o or q for n, (q, o) in SQL.items()} | {n: o for n, (_, o) in FUNCTIONS.items()}
