import datetime as dt
import math

import pytest

from plinth import Session
from plinth.dialect import types as D
from plinth.dialect.diagnostics import Diagnostic
from plinth.dialect.lexer import tokenize
from plinth.dialect.parser import parse
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.register_table("people", spark.createDataFrame([(1, "Ann", 10, "x"), (2, "Bob", 20, "x"), (3, "Cy", None, "y"), (4, None, 40, "y")], "id int, name string, pay int, dep string"))
    s.register_table("deps", spark.createDataFrame([("x", "Ex"), ("z", "Zed")], "dep string, title string"))
    s.register_table("none", spark.createDataFrame([], "k int"))
    return s


def value(session, e):
    return session.query(f"SELECT {e} AS v").first().v


def rows(session, q):
    return [tuple(r) for r in session.query(q).collect()]


def test_tokens():
    assert [t.value for t in tokenize("0b101 0o17 0xFF 1_000 1_0.5")][:-1] == [5, 15, 255, 1000, 10.5]
    assert [t.value for t in tokenize("""'a\\'b' "c\\n" `Q x` /* a /* b */ c */ @V -- end""")][:-1] == ["a'b", "c\n", "Q x", "@v"]
    for bad in ("'open", "/* open", "`open", "§"):
        with pytest.raises(Diagnostic):
            tokenize(bad)


@pytest.mark.parametrize(
    "text,shape",
    [
        ("a OR b IN (1)", ("in", ("binary", "||", "a", "b"))),
        ("-x BETWEEN 1 AND 2", ("unary", "-", ("between", "x"))),
        ("a * b LIKE c", ("binary", "*", "a", ("like", "b", "c"))),
        ("NOT a = b", ("compare", "=", ("not", "a"), "b")),
        ("a | b & c", ("binary", "|", "a", ("binary", "&", "b", "c"))),
        ("a OR b IS NULL", ("is_null", ("binary", "||", "a", "b"))),
        ("a + b << c", ("binary", "<<", ("binary", "+", "a", "b"), "c")),
        ("a ^ b * c", ("binary", "*", ("binary", "^", "a", "b"), "c")),
        ("a = b REGEXP c", ("regexp", ("compare", "=", "a", "b"), "c")),
        ("-a::int", ("cast", ("unary", "-", "a"))),
    ],
)
def test_precedence(text, shape):
    def matches(tree, want):
        if isinstance(want, str) and isinstance(tree, tuple) and tree[0] == "column":
            return tree[1] == want
        if isinstance(want, tuple):
            return tree[0] == want[0] and all(matches(t, w) for t, w in zip(tree[1:], want[1:], strict=False))
        return tree == want

    assert matches(parse("SELECT " + text)[0][1].items[0][0], shape)


@pytest.mark.parametrize(
    "e,want",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("9007199254740993 / 1", 9007199254740993), ("7 % -2", 1), ("2 ^ 10", 1024), ("1.0 / 0.0", math.inf), ("1 + 0.5", 1.5), ("5 # 1", 4), ("~5", -6), ("1 << 3", 8), ("-16 >> 2", -4),
        ("TRUE XOR FALSE", True), ("TRUE OR 't'", True), ("'t' OR FALSE", True), ("NULL AND FALSE", False), ("NULL = 1", None), ("NULL <=> NULL", True), ("1 <=> NULL", False), ("3 IN (1, NULL, 3)", True), ("NULL IN (NULL)", True), ("1 IN ()", False), ("1 NOT IN ()", True),
        ("[1, 2, 3][2:3]", [2, 3]), ("[1, 2, 3][1]", 1), ("[1, 2][:]", [1, 2]), ("[[1], [2, 3]][2]", [2, 3]), ("[1, 2] = [1, 2]", True), ("[1, 2] && [2]", True), ("[1, 2] || [3]", False), ("1 < ALL [2, 3]", True), ("1 > ANY [2, 3]", False), ("'2020-01-02'::date <= ALL ['2020-01-02'::date]", True),
        ("INF > 1.0", True), ("'2020-02-28'::date + 2", dt.date(2020, 3, 1)), ("'2020-01-01 10:11:12.5'::datetime", dt.datetime(2020, 1, 1, 10, 11, 12)), ("'2020-01-01'::date = '2020-01-01'", True), ("2 BETWEEN 1 AND 3", True), ("2 BETWEEN SYMMETRIC 3 AND 1", True), ("2 BETWEEN 3 AND 1", False),
        ("'AbC' LIKE 'a_c'", True), ("'a.c' LIKE 'abc'", False), ("'a\nb' LIKE 'a%'", True), ("'abc' GLOB 'a?c'", True), ("'Abc' GLOB 'a*'", False), ("'a.c' GLOB 'a.c'", True), ("'abc' GLOB 'a.c'", False), ("'abc' GLOB '[ab]*'", True), ("'xaby' REGEXP 'ab'", False), ("'AB' REGEXP '[a-c]+'", True), ("'a b' REGEXP 'a\\\\Sb'", False),
        ("CASE WHEN NULL THEN 1 WHEN TRUE THEN 2 ELSE 3 END", 2), ("IF(TRUE, 1, 2)", 1), ("IFNULL(NULL, 3)", 3), ("GREATEST(1, 5, 3)", 5), ("LEAST(4, 2)", 2), ("TYPEOF([1.5])", "Array(Float)"), ("TYPEOF(NULL)", "Null"), ("ISDATE('2020-01-01'::date)", True), ("ISNUMERIC('1')", False),
        ("LEN('é')", 2), ("LEN('')", 0), ("ASCII('')", 0), ("UNICODE('é')", 233), ("CHAR(128512)", "😀"), ("CHAR(-1)", ""), ("CHAR(55296)", ""), ("CHARINDEX('B', 'abc')", 2), ("CHARINDEX('x', 'abc')", 0), ("REPLACE('aXa.x', 'x.', '$')", "aXa.x"), ("REPLACE('a.b.A', 'A', '-')", "-.b.-"), ("REPLACE('x\\\\E', '\\\\e', '!')", "x!"),
        ("SUBSTRING('hello', 2, 3)", "ell"), ("SUBSTRING('hi', 5, 1)", "hi"), ("SUBSTRING('hi', 1, -1)", ""), ("STUFF('hello', 2, 3, 'XY')", "hXYo"), ("STUFF('hi', 9, 1, 'x')", "hi"), ("LEFT('hello', 2)", "he"), ("RIGHT('hello', 2)", "lo"), ("TRANSLATE('abc', 'ab', 'bc')", "ccc"), ("TRANSLATE('a', 'ab', 'c')", ""),
        ("SOUNDEX('Robert')", "R163"), ("SOUNDEX('tymczak')", "t522"), ("CONCAT('a', 1, NULL)", "a1Null"), ("CONCAT_WS('-', 'a', 'b', 'c', 1)", "a-b-c-1"), ("STRCMP('a', 'b')", -1), ("STRCMP('b', 'b')", 0), ("QUOTENAME('a', '\"')", '"a"'), ("QUOTENAME('a', 'abc')", None), ("STR(3.14159, 6, 2)", "3.14  "), ("STR(7)", "7"), ("TO_HEX(255)", "0xff"),
        ("TRIM('  x\t')", "x"), ("BIN(5)", "101"), ("REVERSE('añb')", "bña"), ("REPLICATE('ab', 2)", "abab"), ("MAKEDATE(2021, 366)", None), ("MAKEDATE(2020, 366)", dt.date(2020, 12, 31)), ("MAKETIME(3, 4, 5)", "3:04:05"), ("TO_DAYS('0001-01-01'::date)", 365), ("WEEKOFYEAR('2024-01-08'::date)", 2), ("WEEKOFYEAR('2023-01-02'::date)", 1), ("YEARWEEK('2023-01-01'::date)", "20231"),
        ("MOD(7, 0)", None), ("`mod`(7, 4)", 3), ("SIGN(-2.5)", -1), ("SQUARE(4)", 16), ("FLOOR(-1.5)", -2), ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ROUND(1.234, 2)", 1.23), ("REGEXP_INSTR('abc', 'c')", 3), ("REGEXP_INSTR('abc', 'x')", -1), ("REGEXP_SUBSTR('abc', 'x')", ""), ("REGEXP_REPLACE('a1', '([a-z])(\\\\d)', '$2$1')", "1a"),
        ("ARRAY_POSITION([1, 2], 3)", None), ("ARRAY_POSITIONS([1, 2, 1], 1)", [1, 3]), ("ARRAY_PREPEND(0, [1])", [0, 1]), ("TRIM_ARRAY([1, 2], 5)", []), ("CARDINALITY([[1, 2], [3, 4]])", 4), ("CARDINALITY([1, 2])", 2), ("ARRAY_DIMS([[1]])", "Array(Array(Int))"), ("ISEMPTY(INT4RANGE(1, 1))", True), ("INT4RANGE(1, 5) @> 5", False), ("INT4RANGE(NULL, 5) @> -9", True),
        ("ROW(1, 'a') != (1, 'b')", True), ("BENCHMARK(3, 1)", 0), ("INTERVAL '1 month' > INTERVAL '29 days'", True), ("'on'::bool", True), ("'off'::bool::int", 0), ("CAST(2.9 AS int)", 2), ("COMMIT_CONVENTIONAL('fix: a: b')", "fix"), ("COMMIT_CONVENTIONAL('fix')", ""),
    ],
)
def test_values(session, e, want):
    assert value(session, e) == want


@pytest.mark.parametrize(
    "q",
    ["SELECT nope FROM people", "SELECT * FROM nowhere", "SELECT 'a' = 1", "SELECT COUNT()", "SELECT id FROM people WHERE COUNT() > 1", "SELECT id, id FROM people", "SELECT id AS name FROM people", "SELECT id FROM people HAVING id > 1", "SELECT id FROM people WHERE ROW_NUMBER() OVER () = 1", "SELECT ROW_NUMBER() FROM people",
     "SELECT SUM(COUNT()) FROM people", "SELECT @x", "SELECT [1, 'a']", "SELECT CAST(1 AS text)", "SELECT lower(1)", "SELECT lower()", "SELECT nofn(1)", "SELECT id FROM people LEFT JOIN deps", "SELECT id FROM people LIMIT x", "SELECT CASE WHEN TRUE THEN 1 END", "SELECT INTERVAL '1 h 1 h'", "SELECT INTERVAL '1 h 1:00:00'", "SELECT * ", "SELECT id FROM people INTO DUMPFILE 'x' FIELDS TERMINATED BY ','", "SELECT 1 SELECT 2", "SELECT [1][0]", "SELECT 1 +"],
)
def test_rejected(session, q):
    with pytest.raises(Diagnostic):
        session.sql(q)


def test_hint(session):
    with pytest.raises(Diagnostic, match="did you mean 'name'"):
        session.sql("SELECT nam FROM people")


def test_clauses(session):
    assert rows(session, "SELECT id FROM people WHERE pay > 15 ORDER BY id") == [(2,), (4,)]
    assert rows(session, "SELECT id FROM people WHERE 'yes' ORDER BY id LIMIT 1, 2") == [(3,)]
    assert rows(session, "SELECT pay FROM people ORDER BY pay") == [(10,), (20,), (40,), (None,)]
    assert rows(session, "SELECT pay FROM people ORDER BY pay DESC") == [(None,), (40,), (20,), (10,)]
    assert rows(session, "SELECT pay FROM people ORDER BY pay DESC NULLS LAST, 1 OFFSET 1 LIMIT 1") == [(20,)]
    assert rows(session, "SELECT dep, COUNT(pay) AS n, SUM(pay) AS s, AVG(pay) AS a, GROUP_CONCAT(name) AS g, ARRAY_AGG(pay) AS arr FROM people GROUP BY dep ORDER BY dep") == [("x", 2, 30, 15, "AnnBob", [10, 20]), ("y", 2, 40, 40, "CyNull", [None, 40])]
    assert rows(session, "SELECT id, title FROM people LEFT JOIN deps ON dep = dep ORDER BY id") == [(1, "Ex"), (2, "Ex"), (3, None), (4, None)]
    assert rows(session, "SELECT title, id FROM people RIGHT JOIN deps ON dep = dep ORDER BY title, id") == [("Ex", 1), ("Ex", 2), ("Zed", None)]
    assert rows(session, "SELECT id FROM people CROSS JOIN none") == []
    assert rows(session, "SELECT COUNT() AS n, SUM(k) AS s FROM none") == [(0, 0)]
    assert rows(session, "SELECT DISTINCT dep FROM people ORDER BY dep LIMIT 1") == [("x",)]
    assert rows(session, "SELECT DISTINCT ON (dep) dep, id FROM people ORDER BY id DESC") == [("y", 4), ("x", 2)]
    assert sorted(rows(session, "SELECT dep, COUNT() AS n FROM people GROUP BY dep WITH ROLLUP"), key=str) == [("x", 2), ("y", 2), (None, 4)]
    assert rows(session, "SELECT name FROM people GROUP BY name ORDER BY name") == [("Ann",), ("Bob",), ("Cy",), (None,)]
    assert rows(session, "SELECT id, SUM(pay) OVER (PARTITION BY dep ORDER BY id) AS s, NTH_VALUE(id, 2) OVER (PARTITION BY dep ORDER BY id) AS t, COUNT() OVER () AS c FROM people ORDER BY id") == [(1, 30, 2, 4), (2, 30, 2, 4), (3, 40, 4, 4), (4, 40, 4, 4)]
    assert rows(session, "SELECT id, ROW_NUMBER() OVER w AS r FROM people QUALIFY r = 1 ORDER BY id WINDOW w AS (PARTITION BY dep ORDER BY pay DESC NULLS LAST)") == [(2, 1), (4, 1)]
    assert rows(session, "SELECT id FROM people ORDER BY id OFFSET 99") == []
    assert [r.kind for r in session.sql("SET @a := 2; DO 1, 2; SELECT @a * 3 AS v;")] == ["set", "do", "select"]
    assert rows(session, "SET @a = '2020-01-01'::date; SELECT @a + 1 AS d") == [(dt.date(2020, 1, 2),)]
    assert rows(session, "DESCRIBE deps") == [("dep", "Text"), ("title", "Text")]


def test_extensions(spark):
    s = Session(spark).register_table("t", spark.createDataFrame([(1,), (2,), (3,)], "k int"))
    s.register_function("twice", "Int", D.INT, lambda c: c * 2)
    s.register_aggregate("spread", "Int", D.INT, lambda c: F.max(c) - F.min(c))
    s.register_window("rank_of", D.INT, lambda args, spec: F.rank().over(spec).cast("bigint"))
    assert rows(s, "SELECT SPREAD(TWICE(k)) AS v FROM t") == [(4,)]
    assert rows(s, "SELECT k, RANK_OF() OVER (ORDER BY k DESC) AS r FROM t ORDER BY k") == [(1, 3), (2, 2), (3, 1)]
    s.register_union("u", [spark.createDataFrame([(1,)], "w int"), spark.createDataFrame([(2,)], "w int")])
    assert rows(s, "SELECT COUNT() AS n FROM u") == [(2,)]
    with pytest.raises(Diagnostic):
        s.register_table("bad", spark.createDataFrame([("x",)], "k string"))


def test_composite(spark):
    s = Session(spark).register_table("c", spark.sql("SELECT named_struct('a', 1L, 'b', 'x') AS p"))
    assert rows(s, "SELECT (p).a + 1 AS v, p.b AS w FROM c") == [(2, "x")]


def test_both_doors_give_the_same_plan_shape(spark):
    s = Session(spark).register_parquet("/root/testdata/sf0.001", "lineitem")
    plan = s.query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 49.0")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
