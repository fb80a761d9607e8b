"""Queries of the dialect's own operators and functions, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.session import Session
from plinth.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _dialect(name: str, tables: str, text: str, sql: str | None) -> None:
    """A query written in the dialect and the same in SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return Session(spark).register_parquet(sf, *tables.split()).query(text)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- relational operators

_dialect(
    "q01_customers_by_orders", "customer orders",
    "SELECT c_custkey, c_name, COUNT() AS n, MAX(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING n > 5 ORDER BY n DESC, c_custkey LIMIT 100",
    "SELECT c_custkey, c_name, CAST(count(*) AS BIGINT) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name HAVING count(*) > 5 ORDER BY n DESC, c_custkey LIMIT 100",
)
_dialect(
    "q02_filter_case", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0.02 THEN 'mid' ELSE 'low' END AS band, l_extendedprice * (1.0 - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND (l_returnflag IN ('A', 'R')) && NOT (l_linestatus = 'O')",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_shipdate, CASE WHEN l_discount > 0.05::DOUBLE THEN 'high' WHEN l_discount > 0.02::DOUBLE THEN 'mid' ELSE 'low' END AS band, l_extendedprice * (1.0::DOUBLE - l_discount) AS net FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O')",
)
_dialect("q03_select_star", "nation", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_dialect("q04_alias_in_where", "part", 'SELECT p_partkey, p_size * 2 AS "Double Size" FROM part WHERE p_retailprice > 950.0 AND `Double Size` > 20', 'SELECT p_partkey, CAST(p_size AS BIGINT) * 2 AS "Double Size" FROM part WHERE p_retailprice > 950 AND p_size * 2 > 20')
_dialect("q05_tableless", "nation", "SELECT 1 + 2 AS a, 'x' AS b, TRUE AS c, 1.5 AS d", "SELECT CAST(3 AS BIGINT) AS a, 'x' AS b, TRUE AS c, CAST(1.5 AS DOUBLE) AS d")
_dialect("q06_variables", "orders", "SET @least = 100000.0; SET @n := 2 + 3; DO @n * 2; SELECT o_orderkey, o_totalprice, @n AS n FROM orders WHERE o_totalprice > @least ORDER BY o_totalprice DESC, o_orderkey OFFSET @n", "SELECT o_orderkey, o_totalprice, CAST(5 AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey OFFSET 5")
_dialect("q07_inner_join", "orders customer", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_dialect("q08_left_join", "orders lineitem", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT OUTER JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40.0", "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40")
_dialect("q09_right_join", "lineitem orders", "SELECT o_orderkey, l_linenumber FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey AND l_discount > 0.09", "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey AND l_discount > 0.09::DOUBLE")
_dialect("q10_cross_join", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_dialect("q11_theta_join", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
_dialect(
    "q12_multi_join", "customer orders nation region",
    "SELECT r_name, COUNT() AS n, SUM(o_orderkey) AS keys FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "SELECT r_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
_dialect("q13_same_name_join", "diffs commits", "SELECT commit_id, title, insertions FROM diffs JOIN commits ON commit_id = commit_id WHERE insertions > 100", "SELECT d.commit_id, c.title, d.insertions FROM diffs d JOIN commits c ON d.commit_id = c.commit_id WHERE d.insertions > 100")
_dialect("q14_group_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, COUNT() AS n, SUM(l_orderkey) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_dialect("q15_global_aggregate", "lineitem", "SELECT COUNT() AS n, MAX(l_shipdate) AS last, SUM(l_linenumber) * 2 + COUNT() AS e FROM lineitem WHERE l_quantity > 25.0", "SELECT CAST(count(*) AS BIGINT) AS n, max(l_shipdate) AS last, CAST(sum(l_linenumber) * 2 + count(*) AS BIGINT) AS e FROM lineitem WHERE l_quantity > 25")
_dialect("q16_group_only", "orders", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_dialect("q17_group_by_expression", "orders", "SELECT year(o_orderdate) AS y, COUNT(o_orderkey) AS n FROM orders GROUP BY y HAVING COUNT(o_orderkey) > 10 ORDER BY y", "SELECT year(o_orderdate) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY y HAVING count(*) > 10 ORDER BY y")
_dialect("q18_first_of_group", "nation region", "SELECT n_regionkey, r_name, COUNT() AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, any_value(r_name) AS r_name, CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
_dialect("q19_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_dialect("q20_distinct_on", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
_dialect("q21_order_nulls_limit", "commits", "SELECT commit_id, author_name, repo FROM commits ORDER BY author_name DESC, commit_id ASC NULLS FIRST, repo USING > LIMIT 50", "SELECT commit_id, author_name, repo FROM commits ORDER BY author_name DESC NULLS FIRST, commit_id ASC NULLS FIRST, repo DESC NULLS FIRST LIMIT 50")
_dialect("q22_limit_shortcut", "part", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey, 1 LIMIT 10, 5", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5")
_dialect("q23_hidden_order_column", "customer", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
_dialect("q24_qualify_latest", "orders", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders QUALIFY rn = 1", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS BIGINT) AS rn FROM orders QUALIFY rn = 1")
_dialect(
    "q25_window_functions", "orders",
    "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w AS f, LAST_VALUE(o_totalprice) OVER w AS l, NTH_VALUE(o_totalprice, 2) OVER w AS s, ROW_NUMBER() OVER w + 10 AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS s, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + 10 AS BIGINT) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
_dialect(
    "q26_window_aggregates", "orders",
    "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS mx, MIN(o_totalprice) OVER (PARTITION BY o_custkey) AS mn, COUNT() OVER (PARTITION BY o_custkey) AS n, SUM(o_orderkey) OVER (PARTITION BY o_custkey) AS s, AVG(o_orderkey) OVER (PARTITION BY o_custkey) AS a, BIT_XOR(o_orderkey) OVER (PARTITION BY o_custkey) AS x, BOOL_OR(o_totalprice > 400000.0) OVER (PARTITION BY o_custkey) AS b FROM orders",
    "SELECT o_orderkey, max(o_totalprice) OVER w AS mx, min(o_totalprice) OVER w AS mn, CAST(count(*) OVER w AS BIGINT) AS n, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s, CAST(sum(o_orderkey) OVER w // count(*) OVER w AS BIGINT) AS a, CAST(bit_xor(o_orderkey) OVER w AS BIGINT) AS x, bool_or(o_totalprice > 400000) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey)",
)
_dialect("q27_show_tables", "nation region", "SHOW TABLES", 'SELECT unnest([\'nation\', \'region\']) AS "Tables"')
_dialect("q28_describe", "nation", "DESCRIBE nation", "SELECT * FROM (VALUES ('n_nationkey', 'Int'), ('n_name', 'Text'), ('n_regionkey', 'Int')) t(field, type)")

# ---------------------------------------------------------------- expressions

_dialect(
    "q30_integer_operators", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * 3 AS m, l_orderkey / (l_linenumber + 1) AS d, 0 - l_orderkey DIV 7 AS dv, l_orderkey % 7 AS r, l_orderkey MOD 5 AS r2, l_linenumber ^ 3 AS p, -l_partkey AS n, +l_partkey AS pl, ~l_partkey AS inv, l_orderkey & 12 AS ba, l_orderkey | 3 AS bo, l_orderkey # 5 AS bx, l_linenumber << 3 AS sl, l_orderkey >> 2 AS sr FROM lineitem",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_orderkey + l_partkey AS a, l_orderkey - l_partkey AS s, l_orderkey * 3 AS m, l_orderkey // (l_linenumber + 1) AS d, 0 - l_orderkey // 7 AS dv, l_orderkey % 7 AS r, l_orderkey % 5 AS r2, CAST(l_linenumber * l_linenumber * l_linenumber AS BIGINT) AS p, -l_partkey AS n, l_partkey AS pl, ~l_partkey AS inv, l_orderkey & 12 AS ba, l_orderkey | 3 AS bo, xor(l_orderkey, CAST(5 AS BIGINT)) AS bx, CAST(l_linenumber AS BIGINT) << 3 AS sl, l_orderkey >> 2 AS sr FROM lineitem",
)
_dialect(
    "q31_float_operators", "part",
    "SELECT p_partkey, p_retailprice + 1.5 AS a, p_retailprice - 2.5 AS s, p_retailprice * 0.5 AS m, p_retailprice / 4.0 AS d, p_retailprice / (p_retailprice - p_retailprice + 0.0) AS inf, -p_retailprice AS n, p_size + 0.5 AS w FROM part",
    "SELECT p_partkey, p_retailprice + 1.5::DOUBLE AS a, p_retailprice - 2.5::DOUBLE AS s, p_retailprice * 0.5::DOUBLE AS m, p_retailprice / 4.0::DOUBLE AS d, CAST('inf' AS DOUBLE) AS inf, -p_retailprice AS n, p_size + 0.5::DOUBLE AS w FROM part",
)
_dialect(
    "q32_boolean_operators", "orders",
    "SELECT o_orderkey, o_totalprice > 200000.0 && o_orderstatus = 'O' AS a, o_totalprice > 200000.0 OR o_orderstatus = 'O' AS b, (o_totalprice > 200000.0) XOR (o_orderstatus = 'O') AS c, !(o_orderstatus = 'F') AS d, TRUE AND 'yes' AS e, o_orderstatus <=> 'F' AS f, o_orderstatus != 'F' AS g, o_orderstatus <> 'O' AS h FROM orders",
    "SELECT o_orderkey, o_totalprice > 200000 AND o_orderstatus = 'O' AS a, o_totalprice > 200000 OR o_orderstatus = 'O' AS b, (o_totalprice > 200000) <> (o_orderstatus = 'O') AS c, o_orderstatus <> 'F' AS d, TRUE AS e, o_orderstatus = 'F' AS f, o_orderstatus <> 'F' AS g, o_orderstatus <> 'O' AS h FROM orders",
)
_dialect(
    "q33_patterns", "part",
    "SELECT p_partkey, p_name LIKE '%A%' AS l, p_name NOT LIKE 'b_%' AS nl, p_type GLOB '*[AEIOU]*' AS g, p_brand REGEXP 'brand#?[0-9]+' AS r, p_brand NOT REGEXP '[a-c].*' AS nr FROM part",
    "SELECT p_partkey, p_name ILIKE '%A%' AS l, NOT (p_name ILIKE 'b_%') AS nl, regexp_matches(p_type, '^.*[AEIOU].*$') AS g, regexp_full_match(lower(p_brand), 'brand#?[0-9]+') AS r, NOT regexp_full_match(lower(p_brand), '[a-c].*') AS nr FROM part",
)
_dialect(
    "q34_membership_null", "commits",
    "SELECT commit_id, repo, author_name IS NULL AS n, message IS NOT NULL AS m, author_name IN ('root', 'dev') AS i, parents_count NOT IN (1, 2) AS ni, title IN () AS e, parents_count BETWEEN SYMMETRIC 2 AND 1 AS b, parents_count NOT BETWEEN 0 AND 1 AS nb FROM commits",
    "SELECT commit_id, repo, author_name IS NULL AS n, message IS NOT NULL AS m, coalesce(author_name IN ('root', 'dev'), FALSE) AS i, coalesce(parents_count NOT IN (1, 2), TRUE) AS ni, FALSE AS e, parents_count BETWEEN 1 AND 2 AS b, NOT (parents_count BETWEEN 0 AND 1) AS nb FROM commits",
)
_dialect(
    "q35_arrays", "nation",
    "SELECT n_nationkey, [n_nationkey, 2, 3][1] AS i, ARRAY[1, 2, 3, 4][2:3] AS s, [1, 2, 3][2:] AS o, [1, 2, 3][:2] AS p, [n_nationkey, 5] @> 5 AS c, 7 <@ [n_nationkey, 9] AS cb, [n_nationkey] || [3, 4] AS ov, n_nationkey = ANY [1, 2, 3] AS an, n_nationkey >= ALL [3, 10] AS al, n_nationkey < SOME [2] AS so FROM nation",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey AS BIGINT) AS i, [2, 3]::BIGINT[] AS s, [2, 3]::BIGINT[] AS o, [1, 2]::BIGINT[] AS p, TRUE AS c, n_nationkey = 7 AS cb, n_nationkey IN (3, 4) AS ov, n_nationkey IN (1, 2, 3) AS an, n_nationkey >= 10 AS al, n_nationkey < 2 AS so FROM nation",
)
_dialect(
    "q36_ranges", "nation",
    "SELECT n_nationkey, int4range(n_nationkey, 10) @> 5 AS c, 5 <@ int4range(0, n_nationkey) AS cb, int4range(0, 20) @> int4range(n_nationkey, 20) AS cr, int4range(0, 5) && int4range(n_nationkey, 30) AS ov, isempty(int4range(n_nationkey, 7)) AS e, daterange('2020-01-01', '2020-02-01') @> '2020-01-31'::date AS d, tsrange('2020-01-01 00:00:00', '2020-01-02 00:00:00') @> '2020-01-02 00:00:00'::datetime AS t FROM nation",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 5 >= n_nationkey AS c, 5 < n_nationkey AS cb, TRUE AS cr, n_nationkey < 5 AS ov, n_nationkey = 7 AS e, TRUE AS d, FALSE AS t FROM nation",
)
_dialect(
    "q37_casts", "part",
    "SELECT p_partkey, CAST(p_retailprice AS Int) AS i, p_size::float AS f, (p_size % 2)::bool AS b, ('on')::bool AS o, CAST('off' AS Boolean) AS o2, CAST(TRUE AS Int) AS n, '2021-03-04'::date AS d, '2021-03-04 05:06:07'::datetime::date AS d2, '2021-03-04'::date::datetime AS t, '1'::bool::int AS two FROM part",
    "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS f, p_size % 2 = 1 AS b, TRUE AS o, FALSE AS o2, CAST(1 AS BIGINT) AS n, DATE '2021-03-04' AS d, DATE '2021-03-04' AS d2, TIMESTAMP '2021-03-04 00:00:00' AS t, CAST(1 AS BIGINT) AS two FROM part",
)
_dialect(
    "q38_rows_and_precedence", "nation",
    "SELECT n_nationkey, ROW(n_nationkey, 'a') = (1, 'a') AS r, (n_nationkey, 2) != (3, 2) AS ne, 2 * 3 ^ 2 AS m, 1 + 2 << 1 AS sh, n_nationkey = 1 OR n_nationkey = 2 IN (TRUE) AS p, 6 & 3 # 1 | 8 AS q, BENCHMARK(10, n_nationkey * 2) AS b FROM nation",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_nationkey = 1 AS r, n_nationkey <> 3 AS ne, CAST(36 AS BIGINT) AS m, CAST(6 AS BIGINT) AS sh, n_nationkey IN (1, 2) AS p, CAST(11 AS BIGINT) AS q, CAST(0 AS BIGINT) AS b FROM nation",
)
_dialect(
    "q39_intervals", "nation",
    "SELECT n_nationkey, INTERVAL '1 year 2 mons' < INTERVAL '14 mons 6 days' AS lt, INTERVAL '1 d' = INTERVAL '24 h' AS eq, INTERVAL '1 y 3 d' + INTERVAL '2 y' = INTERVAL '3 y 3 d' AS ad, INTERVAL '5 d 3 h' - INTERVAL '2 d' = INTERVAL '3 d 3 h' AS su, INTERVAL '1 d 2 h' * n_nationkey = INTERVAL '3 d 6 h' AS mu, INTERVAL '7 d' / 2 = INTERVAL '3 d' AS di, justify_days(INTERVAL '65 days') = INTERVAL '2 mons 5 days' AS jd, justify_hours(INTERVAL '50 hours') = INTERVAL '2 days 2 hours' AS jh, INTERVAL '1 y 1 m 1 w 1 d ago' = INTERVAL '1 y 1 m 1 w 1 d' * -1 AS ago FROM nation",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, NOT (365.25 + 60 >= 420 + 6) AS lt, FALSE AS eq, TRUE AS ad, TRUE AS su, n_nationkey = 3 AS mu, TRUE AS di, TRUE AS jd, TRUE AS jh, TRUE AS ago FROM nation",
)

# ---------------------------------------------------------------- functions

_TEXT_SOUNDEX = "substr(c_name, 1, 1) || rpad(substr(translate(regexp_replace(regexp_replace(upper(substr(c_name, 2)), '[AEIOUHWY]', '', 'g'), '[^BFPVCGJKQSXZDTLMNR]', '0', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), 1, 3), 3, '0')"
_dialect(
    "q40_text_functions", "customer",
    "SELECT c_custkey, bin(c_custkey) AS f_bin, lower(c_name) AS f_lower, upper(c_name) AS f_upper, reverse(c_name) AS f_reverse, replicate(c_name, 2) AS f_rep, concat('[', space(3), ']') AS f_space, trim('  x ') AS f_trim, ltrim('  x ') AS f_ltrim, rtrim('  x ') AS f_rtrim, len(c_name) AS f_len, ascii(c_name) AS f_ascii, left(c_name, 4) AS f_left, right(c_name, 4) AS f_right, datalength(c_name) AS f_dl, char(65 + c_custkey % 26) AS f_char, nchar(97 + c_custkey % 26) AS f_nchar FROM customer",
    "SELECT c_custkey, bin(c_custkey) AS f_bin, lower(c_name) AS f_lower, upper(c_name) AS f_upper, reverse(c_name) AS f_reverse, repeat(c_name, 2) AS f_rep, '[   ]' AS f_space, 'x' AS f_trim, 'x ' AS f_ltrim, '  x' AS f_rtrim, CAST(strlen(c_name) AS BIGINT) AS f_len, CAST(unicode(c_name) AS BIGINT) AS f_ascii, left(c_name, 4) AS f_left, right(c_name, 4) AS f_right, CAST(strlen(c_name) AS BIGINT) AS f_dl, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS f_char, chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS f_nchar FROM customer",
)
_dialect(
    "q41_text_functions_2", "customer",
    "SELECT c_custkey, charindex('MER', c_name) AS f_ci, replace(c_name, 'CUST', '$1') AS f_replace, substring(c_name, 2, 3) AS f_sub, stuff(c_name, 2, 2, 'XY') AS f_stuff, translate(c_name, 'Cue', 'xyz') AS f_tr, soundex(c_name) AS f_sx, concat(c_name, '-', c_custkey) AS f_concat, concat_ws(', ', c_name, c_custkey, NULL) AS f_ws, unicode(c_name) AS f_uni, strcmp(c_name, 'Customer#000000500') AS f_cmp, quotename(c_name) AS f_q, quotename(c_name, '()') AS f_q2, str(c_acctbal, 12, 2) AS f_str, to_hex(c_custkey) AS f_hex FROM customer",
    f"SELECT c_custkey, CAST(instr(lower(c_name), 'mer') AS BIGINT) AS f_ci, regexp_replace(c_name, '(?i)cust', '$1', 'g') AS f_replace, substr(c_name, 2, 3) AS f_sub, substr(c_name, 1, 1) || 'XY' || substr(c_name, 4) AS f_stuff, translate(c_name, 'Cue', 'xyz') AS f_tr, {_TEXT_SOUNDEX} AS f_sx, c_name || '-' || c_custkey AS f_concat, c_name || ', ' || c_custkey || ', Null' AS f_ws, CAST(unicode(c_name) AS BIGINT) AS f_uni, CAST(CASE WHEN c_name < 'Customer#000000500' THEN -1 WHEN c_name = 'Customer#000000500' THEN 0 ELSE 1 END AS BIGINT) AS f_cmp, '[' || c_name || ']' AS f_q, '(' || c_name || ')' AS f_q2, rpad(printf('%.2f', c_acctbal), 12, ' ') AS f_str, '0x' || lower(to_hex(c_custkey)) AS f_hex FROM customer",
)
_dialect("q42_text_multibyte", "documents", "SELECT doc_id, len(text) AS b, left(text, 20) AS l, unicode(text) AS u, charindex('der', text) > 0 AS h, n_chars FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS b, left(text, 20) AS l, CAST(unicode(text) AS BIGINT) AS u, instr(lower(text), 'der') > 0 AS h, n_chars FROM documents")
_dialect(
    "q43_date_functions", "orders",
    "SELECT o_orderkey, date(o_orderdate) AS d, day(o_orderdate) AS f_day, dayname(o_orderdate) AS f_dn, monthname(o_orderdate) AS f_mn, hour(o_orderdate) AS f_h, minute(o_orderdate) AS f_m, dayofweek(o_orderdate) AS f_dow, dayofmonth(o_orderdate) AS f_dom, dayofyear(o_orderdate) AS f_doy, quarter(o_orderdate) AS f_q, year(o_orderdate) AS f_y, month(o_orderdate) AS f_mo, weekday(o_orderdate) AS f_wd, last_day(date(o_orderdate)) AS f_ld, isdate(date(o_orderdate)) AS f_is, date(o_orderdate) + 40 AS f_plus, date(o_orderdate) - 40 AS f_minus FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS f_day, dayname(o_orderdate) AS f_dn, monthname(o_orderdate) AS f_mn, hour(o_orderdate) AS f_h, minute(o_orderdate) AS f_m, dayofweek(o_orderdate) + 1 AS f_dow, day(o_orderdate) AS f_dom, dayofyear(o_orderdate) AS f_doy, quarter(o_orderdate) AS f_q, year(o_orderdate) AS f_y, month(o_orderdate) AS f_mo, isodow(o_orderdate) - 1 AS f_wd, last_day(CAST(o_orderdate AS DATE)) AS f_ld, TRUE AS f_is, CAST(o_orderdate AS DATE) + 40 AS f_plus, CAST(o_orderdate AS DATE) - 40 AS f_minus FROM orders",
)
_WEEK = "((dayofyear(o_orderdate) - 1 + CASE WHEN isodow(date_trunc('year', o_orderdate)) = 1 THEN 0 ELSE 1 END) // 7 + 1)"
_LEAPS = "((year(o_orderdate) - 1) // 4 - (year(o_orderdate) - 1) // 100 + (year(o_orderdate) - 1) // 400)"
_dialect(
    "q44_date_functions_2", "orders",
    "SELECT o_orderkey, makedate(year(o_orderdate), 60) AS f_md, maketime(o_orderkey % 24, 5, 9) AS f_mt, weekofyear(o_orderdate) AS f_w, yearweek(o_orderdate) AS f_yw, to_days(o_orderdate) AS f_td FROM orders",
    f"SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) + 59 AS f_md, (o_orderkey % 24) || ':05:09' AS f_mt, {_WEEK} AS f_w, year(o_orderdate) || '' || {_WEEK} AS f_yw, (year(o_orderdate) - {_LEAPS}) * 365 + {_LEAPS} * 366 + dayofyear(o_orderdate) - 1 AS f_td FROM orders",
)
_dialect(
    "q45_number_functions", "customer",
    "SELECT c_custkey, abs(c_acctbal) AS f_abs, abs(0 - c_custkey) AS f_absi, round(pi(), 6) AS f_pi, floor(c_acctbal) AS f_floor, round(c_acctbal) AS f_round, square(c_custkey) AS f_sq, round(sin(c_acctbal), 6) AS f_sin, round(asin(0.5), 6) AS f_asin, round(cos(c_acctbal), 6) AS f_cos, round(acos(0.5), 6) AS f_acos, round(tan(0.5), 6) AS f_tan, round(atan(c_acctbal), 6) AS f_atan, round(atn2(c_acctbal, 3.0), 6) AS f_atn2, sign(c_acctbal) AS f_sign, sign(0 - c_custkey) AS f_signi, mod(c_custkey, 7) AS f_mod, mod(c_custkey, 0) AS f_mod0 FROM customer",
    "SELECT c_custkey, abs(c_acctbal) AS f_abs, abs(0 - c_custkey) AS f_absi, 3.141593::DOUBLE AS f_pi, CAST(floor(c_acctbal) AS BIGINT) AS f_floor, round(c_acctbal) AS f_round, c_custkey * c_custkey AS f_sq, round(sin(c_acctbal), 6) AS f_sin, round(asin(0.5::DOUBLE), 6) AS f_asin, round(cos(c_acctbal), 6) AS f_cos, round(acos(0.5::DOUBLE), 6) AS f_acos, round(tan(0.5::DOUBLE), 6) AS f_tan, round(atan(c_acctbal), 6) AS f_atan, round(atan2(c_acctbal, 3.0::DOUBLE), 6) AS f_atn2, CAST(sign(c_acctbal) AS BIGINT) AS f_sign, CAST(sign(0 - c_custkey) AS BIGINT) AS f_signi, c_custkey % 7 AS f_mod, CAST(NULL AS BIGINT) AS f_mod0 FROM customer",
)
_dialect(
    "q46_general_functions", "commits",
    "SELECT commit_id, repo, isnull(author_name) AS a, isnumeric(parents_count) AS b, isnumeric(title) AS b2, typeof(datetime) AS c, typeof([parents_count]) AS c2, greatest(parents_count, 1, 0) AS g, least(parents_count, 1) AS l, if(parents_count > 1, 'merge', 'plain') AS i, ifnull(author_name, 'nobody') AS n FROM commits",
    "SELECT commit_id, repo, author_name IS NULL AS a, TRUE AS b, FALSE AS b2, 'DateTime' AS c, 'Array(Int)' AS c2, greatest(parents_count, 1, 0) AS g, least(parents_count, 1) AS l, CASE WHEN parents_count > 1 THEN 'merge' ELSE 'plain' END AS i, coalesce(author_name, 'nobody') AS n FROM commits",
)
_dialect(
    "q47_regex_functions", "commits",
    "SELECT commit_id, repo, regexp_instr(author_email, '@[a-m]') AS i, regexp_like(title, '^(fix|feat)') AS l, regexp_replace(title, '([a-z]+)-', '<$1>') AS r, regexp_substr(title, '[a-z]+') AS s FROM commits",
    "SELECT commit_id, repo, CASE WHEN author_email IS NULL THEN NULL WHEN regexp_extract(author_email, '@[a-m]') = '' THEN -1 ELSE CAST(instr(author_email, regexp_extract(author_email, '@[a-m]')) AS BIGINT) END AS i, regexp_matches(title, '^(fix|feat)') AS l, regexp_replace(title, '([a-z]+)-', '<\\1>', 'g') AS r, regexp_extract(title, '[a-z]+') AS s FROM commits",
)
_dialect(
    "q48_array_functions", "nation",
    "SELECT n_nationkey, array_append([1, 2], n_nationkey) AS a, array_prepend(n_nationkey, [1, 2]) AS b, array_remove([1, 2, 1, 3], 1) AS c, array_cat([1], [n_nationkey, 2]) AS d, array_length([n_nationkey, 2, 3]) AS e, array_position([5, n_nationkey, 7], 7) AS f, array_position([1], 2) AS f2, array_positions([1, 2, 1], 1) AS g, array_dims([[1, 2]]) AS h, array_replace([1, n_nationkey], 1, 9) AS i, trim_array([1, 2, 3], 2) AS j, cardinality([[1, 2], [3, 4]]) AS k, array_length(array_shuffle([1, 2, 3])) AS l FROM nation",
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, [1, 2, n_nationkey]::BIGINT[] AS a, [n_nationkey, 1, 2]::BIGINT[] AS b, [2, 3]::BIGINT[] AS c, [1, n_nationkey, 2]::BIGINT[] AS d, CAST(3 AS BIGINT) AS e, CASE WHEN n_nationkey = 7 THEN 2 ELSE 3 END::BIGINT AS f, NULL::BIGINT AS f2, [1, 3]::BIGINT[] AS g, 'Array(Array(Int))' AS h, [9, CASE WHEN n_nationkey = 1 THEN 9 ELSE n_nationkey END]::BIGINT[] AS i, [1]::BIGINT[] AS j, CAST(4 AS BIGINT) AS k, CAST(3 AS BIGINT) AS l FROM nation",
)
_dialect(
    "q49_aggregates", "lineitem",
    "SELECT l_returnflag, MAX(l_quantity) AS mx, MIN(l_shipdate) AS mn, SUM(l_linenumber) AS s, AVG(l_linenumber) AS a, COUNT(l_partkey) AS n, BOOL_AND(l_linenumber > 0) AS ba, BOOL_OR(l_linenumber > 6) AS bo, BIT_AND(l_orderkey) AS xa, BIT_OR(l_orderkey) AS xo, BIT_XOR(l_orderkey) AS xx FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, max(l_quantity) AS mx, min(l_shipdate) AS mn, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS n, bool_and(l_linenumber > 0) AS ba, bool_or(l_linenumber > 6) AS bo, bit_and(l_orderkey) AS xa, bit_or(l_orderkey) AS xo, bit_xor(l_orderkey) AS xx FROM lineitem GROUP BY l_returnflag",
)
_dialect("q50_text_and_array_aggregates", "nation", "SELECT n_regionkey, GROUP_CONCAT(n_name, ';') AS g, ARRAY_AGG(n_nationkey) AS a FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, string_agg(n_name || ';', '' ORDER BY n_name || ';') AS g, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey")
_dialect("q51_aggregates_of_null", "commits", "SELECT repo, COUNT(author_name) AS n, MAX(author_name) AS m, GROUP_CONCAT(committer_name) AS g FROM commits GROUP BY repo", "SELECT repo, CAST(count(*) AS BIGINT) AS n, max(author_name) AS m, string_agg(coalesce(committer_name, 'Null'), '' ORDER BY coalesce(committer_name, 'Null') COLLATE C) AS g FROM commits GROUP BY repo")
_dialect("q52_commit_functions", "commits", "SELECT commit_conventional(title) AS kind, COUNT() AS n FROM commits GROUP BY kind", "SELECT CASE WHEN instr(title, ':') > 0 THEN split_part(title, ':', 1) WHEN title IS NOT NULL THEN '' END AS kind, CAST(count(*) AS BIGINT) AS n FROM commits GROUP BY kind")
_dialect(
    "q53_diff_functions", "diffs",
    "SELECT commit_id, repo, diff_files_count(diff_changes) AS n, diff_changed_files(diff_changes) AS f, is_diff_has_file(diff_changes, 'src/lib.rs') AS h FROM diffs",
    "SELECT commit_id, repo, CAST(len(list_distinct([coalesce(x.location, chr(1)) FOR x IN diff_changes])) AS BIGINT) AS n, [x.location FOR x IN diff_changes] AS f, len([x FOR x IN diff_changes IF x.location = 'src/lib.rs']) > 0 AS h FROM diffs",
)
_HEX = "array_to_string([hex(x.content) FOR x IN diff_changes IF x.content IS NOT NULL{}], '')"
_HAS = "contains(" + _HEX + ", hex('packet'))"
_BYTES = "CAST(coalesce(list_sum([octet_length(x.content) FOR x IN diff_changes IF x.content IS NOT NULL{}]), 0) AS BIGINT)"
_OF_KIND = " AND x.kind = '{}'"
_CONTENT_SQL = (
    f"SELECT commit_id, repo, {_HAS.format('')} AS c, "
    + ", ".join(_HAS.format(_OF_KIND.format(k)) + f" AS {k.lower()}" for k in "ADM")
    + f", TRUE AS o, {_BYTES.format(_OF_KIND.format('D'))} AS dl, {_BYTES.format(_OF_KIND.format('M'))} > 0 AS ml FROM diffs"
)
_dialect(
    "q54_diff_content", "diffs",
    "SELECT commit_id, repo, diff_content_contains(diff_changes, 'packet') AS c, diff_added_content_contains(diff_changes, 'packet') AS a, diff_deleted_content_contains(diff_changes, 'packet') AS d, diff_modified_content_contains(diff_changes, 'packet') AS m, len(diff_content(diff_changes)) >= len(diff_added_content(diff_changes)) AS o, len(diff_deleted_content(diff_changes)) AS dl, len(diff_modified_content(diff_changes)) > 0 AS ml FROM diffs",
    _CONTENT_SQL,
)


# ---------------------------------------------------------------- the DataFrame door, one plan for each access pattern


def q60_dataframe_door(spark: SparkSession, sf: str) -> DataFrame:
    """The functions without the dialect: pruned scan, pushed filter, partial aggregation, top-k."""
    from plinth.functions import aggregate as ag
    from plinth.functions import datetime as fd

    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    grouped = li.groupBy(fd.year(F.col("l_shipdate")).alias("y"), "l_returnflag")
    return grouped.agg(ag.count().alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES["q60_dataframe_door"] = q60_dataframe_door
SQL["q60_dataframe_door"] = "SELECT year(l_shipdate) AS y, l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY y, l_returnflag"
