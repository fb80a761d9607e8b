"""Signatures of the library functions: parameters, result type, and the Column they build.

Parameter kinds: a type name, Num (Int or Float), DateLike (Date or DateTime), Array, Range, Any,
Same (the type of the first argument), Elem (element type of the first array argument); ``?`` after a
kind makes it optional, ``*`` lets it repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F

from plinth.dialect import types as D
from plinth.dialect.diagnostics import Diagnostic
from plinth.functions import array as fa
from plinth.functions import datetime as fd
from plinth.functions import diff as fx
from plinth.functions import general as fg
from plinth.functions import interval as fi
from plinth.functions import number as fn
from plinth.functions import range_ as fr
from plinth.functions import regex as fe
from plinth.functions import text as ft


@dataclass(frozen=True)
class Function:
    params: tuple[str, ...]
    result: object  # a Type, or a function of the argument types
    build: Callable  # of Typed arguments


def _f(params: str, result, build) -> Function:
    return Function(tuple(params.split()), result, build)


def _c(fn: Callable) -> Callable:
    """A builder that passes the argument columns on."""
    return lambda *a: fn(*(x.col for x in a))


def _lit(x, what: str):
    if x.value is None:
        raise Diagnostic(f"{what} must be a literal")
    return x.value


_same = lambda *t: next((x for x in t if x != D.NULL), D.NULL)
_first = lambda *t: t[0]


def _rank(t: D.Type) -> int:
    return 1 + _rank(t.args[0]) if t.name == "Array" and t.args else 0


def _str(x, n=None, d=None):
    return ft.str_(x.col, None if n is None or d is None else n.col, 0 if d is None else int(_lit(d, "The number of decimals")))


SCALAR: dict[str, Function] = {
    # text
    "bin": _f("Int", D.TEXT, _c(ft.bin_)), "lower": _f("Text", D.TEXT, _c(ft.lower)), "upper": _f("Text", D.TEXT, _c(ft.upper)), "reverse": _f("Text", D.TEXT, _c(ft.reverse)),
    "replicate": _f("Text Int", D.TEXT, _c(ft.replicate)), "space": _f("Int", D.TEXT, _c(ft.space)), "trim": _f("Text", D.TEXT, _c(ft.trim)), "ltrim": _f("Text", D.TEXT, _c(ft.ltrim)), "rtrim": _f("Text", D.TEXT, _c(ft.rtrim)),
    "len": _f("Text", D.INT, _c(ft.len_)), "ascii": _f("Text", D.INT, _c(ft.ascii_)), "left": _f("Text Int", D.TEXT, _c(ft.left)), "datalength": _f("Text", D.INT, _c(ft.len_)), "char": _f("Int", D.TEXT, _c(ft.char)), "nchar": _f("Int", D.TEXT, _c(ft.char)),
    "charindex": _f("Text Text", D.INT, _c(ft.charindex)), "replace": _f("Text Text Text", D.TEXT, _c(ft.replace)), "substring": _f("Text Int Int", D.TEXT, _c(ft.substring)), "stuff": _f("Text Int Int Text", D.TEXT, _c(ft.stuff)), "right": _f("Text Int", D.TEXT, _c(ft.right)),
    "translate": _f("Text Text Text", D.TEXT, _c(ft.translate)), "soundex": _f("Text", D.TEXT, _c(ft.soundex)), "concat": _f("Any Any Any*", D.TEXT, lambda *a: ft.concat(*(x.text() for x in a))), "concat_ws": _f("Text Any Any Any*", D.TEXT, lambda s, *a: ft.concat_ws(s.col, *(x.text() for x in a))),
    "unicode": _f("Text", D.INT, _c(ft.unicode_)), "strcmp": _f("Text Text", D.INT, _c(ft.strcmp)), "quotename": _f("Text Text?", D.TEXT, _c(ft.quotename)), "str": _f("Num Int? Int?", D.TEXT, _str), "to_hex": _f("Int", D.TEXT, _c(ft.to_hex)),
    # date and time
    "date": _f("DateLike", D.DATE, _c(fd.date)), "current_date": _f("", D.DATE, _c(fd.current_date)), "current_time": _f("", D.TIME, _c(fd.current_time)), "current_timestamp": _f("", D.DATETIME, _c(fd.current_timestamp)), "now": _f("", D.DATETIME, _c(fd.now)),
    "makedate": _f("Int Int", D.DATE, _c(fd.makedate)), "maketime": _f("Int Int Int", D.TIME, _c(fd.maketime)), "day": _f("Date", D.INT, _c(fd.day)), "dayname": _f("Date", D.TEXT, _c(fd.dayname)), "monthname": _f("Date", D.TEXT, _c(fd.monthname)), "hour": _f("DateTime", D.INT, _c(fd.hour)),
    "minute": _f("DateTime", D.INT, _c(fd.minute)), "isdate": _f("Any", D.BOOL, lambda x: F.lit(x.type == D.DATE)), "dayofweek": _f("Date", D.INT, _c(fd.dayofweek)), "dayofmonth": _f("Date", D.INT, _c(fd.day)), "dayofyear": _f("Date", D.INT, _c(fd.dayofyear)), "weekofyear": _f("Date", D.INT, _c(fd.weekofyear)),
    "quarter": _f("Date", D.INT, _c(fd.quarter)), "year": _f("Date", D.INT, _c(fd.year)), "month": _f("Date", D.INT, _c(fd.month)), "weekday": _f("Date", D.INT, _c(fd.weekday)), "to_days": _f("Date", D.INT, _c(fd.to_days)), "last_day": _f("Date", D.DATE, _c(fd.last_day)), "yearweek": _f("Date", D.TEXT, _c(fd.yearweek)),
    "justify_days": _f("Interval", D.INTERVAL, _c(fi.justify_days)), "justify_hours": _f("Interval", D.INTERVAL, _c(fi.justify_hours)),
    # numbers
    "abs": _f("Num", _first, _c(fn.abs_)), "pi": _f("", D.FLOAT, _c(fn.pi)), "floor": _f("Float", D.INT, _c(fn.floor)), "round": _f("Float Int?", D.FLOAT, lambda x, n=None: fn.round_(x.col, 0 if n is None else int(_lit(n, "The number of digits")))), "square": _f("Int", D.INT, _c(fn.square)),
    "sin": _f("Float", D.FLOAT, _c(fn.sin)), "asin": _f("Float", D.FLOAT, _c(fn.asin)), "cos": _f("Float", D.FLOAT, _c(fn.cos)), "acos": _f("Float", D.FLOAT, _c(fn.acos)), "tan": _f("Float", D.FLOAT, _c(fn.tan)), "atan": _f("Float", D.FLOAT, _c(fn.atan)), "atn2": _f("Float Float", D.FLOAT, _c(fn.atn2)),
    "sign": _f("Num", D.INT, _c(fn.sign)), "mod": _f("Int Int", D.INT, _c(fn.mod)), "rand": _f("Float?", D.FLOAT, lambda s=None: fn.rand(None if s is None else int(_lit(s, "The seed")))),
    # general
    "isnull": _f("Any", D.BOOL, _c(fg.isnull)), "isnumeric": _f("Any", D.BOOL, lambda x: F.lit(x.type in (D.INT, D.FLOAT))), "typeof": _f("Any", D.TEXT, lambda x: F.lit(str(x.type))), "greatest": _f("Any Same Same*", _same, _c(fg.greatest)), "least": _f("Any Same Same*", _same, _c(fg.least)), "uuid": _f("", D.TEXT, _c(fg.uuid)),
    "if": _f("Boolean Any Any", lambda _, a, b: _same(a, b), _c(fg.if_)), "ifnull": _f("Any Same", _same, _c(fg.ifnull)),
    # regular expressions
    "regexp_instr": _f("Text Text", D.INT, _c(fe.regexp_instr)), "regexp_like": _f("Text Text", D.BOOL, _c(fe.regexp_like)), "regexp_replace": _f("Text Text Text", D.TEXT, _c(fe.regexp_replace)), "regexp_substr": _f("Text Text", D.TEXT, _c(fe.regexp_substr)),
    # arrays
    "array_append": _f("Array Elem", _first, _c(fa.array_append)), "array_prepend": _f("Any Array", lambda _, a: a, _c(fa.array_prepend)), "array_remove": _f("Array Elem", _first, _c(fa.array_remove)), "array_cat": _f("Array Array", _first, _c(fa.array_cat)), "array_length": _f("Array", D.INT, _c(fa.array_length)),
    "array_shuffle": _f("Array", _first, _c(fa.array_shuffle)), "array_position": _f("Array Elem", D.INT, _c(fa.array_position)), "array_positions": _f("Array Elem", D.array(D.INT), _c(fa.array_positions)), "array_dims": _f("Array", D.TEXT, lambda x: F.lit(str(x.type))), "array_replace": _f("Array Elem Elem", _first, _c(fa.array_replace)),
    "trim_array": _f("Array Int", _first, _c(fa.trim_array)), "cardinality": _f("Array", D.INT, lambda x: fa.cardinality(x.col, _rank(x.type))),
    # ranges
    "int4range": _f("Int Int", D.range_(D.INT), _c(fr.int4range)), "daterange": _f("Date Date", D.range_(D.DATE), _c(fr.daterange)), "tsrange": _f("DateTime DateTime", D.range_(D.DATETIME), _c(fr.tsrange)), "isempty": _f("Range", D.BOOL, _c(fr.isempty)),
    # commits and their changes
    "commit_conventional": _f("Text", D.TEXT, _c(ft.commit_conventional)), "diff_content": _f("DiffChanges", D.TEXT, _c(fx.content)), "diff_added_content": _f("DiffChanges", D.TEXT, _c(fx.added_content)), "diff_deleted_content": _f("DiffChanges", D.TEXT, _c(fx.deleted_content)), "diff_modified_content": _f("DiffChanges", D.TEXT, _c(fx.modified_content)),
    "diff_content_contains": _f("DiffChanges Text", D.BOOL, _c(fx.content_contains)), "diff_added_content_contains": _f("DiffChanges Text", D.BOOL, _c(fx.added_content_contains)), "diff_deleted_content_contains": _f("DiffChanges Text", D.BOOL, _c(fx.deleted_content_contains)), "diff_modified_content_contains": _f("DiffChanges Text", D.BOOL, _c(fx.modified_content_contains)),
    "diff_changed_files": _f("DiffChanges", D.array(D.TEXT), _c(fx.changed_files)), "diff_files_count": _f("DiffChanges", D.INT, _c(fx.files_count)), "is_diff_has_file": _f("DiffChanges Text", D.BOOL, _c(fx.has_file)),
}

AGGREGATES = ("max", "min", "sum", "avg", "count", "group_concat", "bool_and", "bool_or", "bit_and", "bit_or", "bit_xor", "array_agg")
WINDOWS = ("first_value", "nth_value", "last_value", "row_number")
