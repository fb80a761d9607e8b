"""Trees to DataFrames: names, types and clauses are resolved here; Catalyst does the rest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.dialect import types as D
from plinth.dialect.diagnostics import Diagnostic, did_you_mean
from plinth.dialect.parser import Select, WindowDef
from plinth.dialect.registry import AGGREGATES, WINDOWS, Function
from plinth.functions import aggregate as ag
from plinth.functions import array as fa
from plinth.functions import interval as fi
from plinth.functions import number as fn
from plinth.functions import range_ as fr
from plinth.functions import regex as fe
from plinth.functions import window as fw
from plinth.operators.ranks import numbered


@dataclass(frozen=True)
class Typed:
    col: Column
    type: D.Type
    value: object = None  # of a literal
    constant: bool = False

    def text(self) -> Column:
        """Text form as results show it."""
        if self.type == D.INTERVAL:
            return fi.show(self.col)
        return self.col.cast("string")


def key(tree) -> str:
    """Equal for equal expressions, wherever they stand in the text."""
    if isinstance(tree, tuple):
        if tree and tree[0] == "column":
            return f"column:{tree[1]}"
        if tree and tree[0] == "call":
            return f"call:{tree[1]}({key(tree[2])}){key(tree[3])}"
        return "(" + ",".join(map(key, tree)) + ")"
    if isinstance(tree, list):
        return "[" + ",".join(map(key, tree)) + "]"
    return repr(tree)


def calls(tree, test) -> list[tuple]:
    """All call nodes a test accepts, outermost first."""
    found: list[tuple] = []
    if isinstance(tree, tuple):
        if tree and tree[0] == "call" and test(tree):
            found.append(tree)
        for x in tree:
            found += calls(x, test)
    elif isinstance(tree, list):
        for x in tree:
            found += calls(x, test)
    return found


def names_in(tree) -> list[str]:
    if isinstance(tree, tuple):
        if tree and tree[0] == "column":
            return [tree[1]]
        return [n for x in tree for n in names_in(x)]
    if isinstance(tree, list):
        return [n for x in tree for n in names_in(x)]
    if isinstance(tree, WindowDef):
        return names_in(tree.partition) + [n for o in tree.order for n in names_in(o.expr)]
    return []


def all_names(x) -> Iterator[str]:
    """Every column name, and every text that might be one, anywhere in a statement."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, (tuple, list)):
        for y in x:
            yield from all_names(y)
    elif isinstance(x, dict):
        yield from all_names(list(x.values()))
    elif is_dataclass(x):
        yield from all_names([getattr(x, f.name) for f in fields(x)])


def is_plain_aggregate(c) -> bool:
    return c[1] in AGGREGATES and c[3] is None


_LITERALS = {D.INT: "bigint", D.FLOAT: "double", D.TEXT: "string", D.BOOL: "boolean", D.DATE: "date", D.DATETIME: "timestamp_ntz", D.TIME: "string"}


class Scope:
    """What names mean in one stage of a query."""

    def __init__(self, lowering: Lowering, columns: dict[str, Typed], aliases: dict[str, tuple] | None = None, given: dict[str, Typed] | None = None) -> None:
        self.lowering, self.columns, self.aliases, self.given = lowering, columns, aliases or {}, given or {}

    def lower(self, tree: tuple) -> Typed:
        known = self.given.get(key(tree))
        return known if known is not None else getattr(self, "_" + tree[0])(*tree[1:])

    # ---- leaves

    def _int(self, v):
        return Typed(F.lit(v).cast("bigint"), D.INT, v, True)

    def _float(self, v):
        return Typed(F.lit(float(v)), D.FLOAT, v, True)

    def _text(self, v):
        return Typed(F.lit(v), D.TEXT, v, True)

    def _bool(self, v):
        return Typed(F.lit(v), D.BOOL, v, True)

    def _null(self):
        return Typed(F.lit(None), D.NULL, None, True)

    def _interval(self, fields):
        return Typed(fi.make(**fields), D.INTERVAL, None, True)

    def _variable(self, name):
        got = self.lowering.variables.get(name)
        if got is None:
            raise Diagnostic(f"The variable {name} has no value")
        return got

    def _column(self, name, at):
        if name in self.columns:
            return self.columns[name]
        if name in self.aliases:
            inner = Scope(self.lowering, self.columns, {k: v for k, v in self.aliases.items() if k != name}, self.given)
            return inner.lower(self.aliases[name])
        raise Diagnostic(f"No column is named {name!r}", at, did_you_mean(name, [*self.columns, *self.aliases]))

    # ---- conversions

    def implicit(self, x: Typed, to: D.Type) -> Typed | None:
        """``x`` as ``to`` if the rules allow it without being asked."""
        if x.type == to or to in (D.ANY, D.NULL):
            return x
        if x.type == D.NULL:
            return Typed(x.col.cast(D.spark_type(to)) if to.name not in ("Composite", "Row", "DiffChanges") else x.col, to, None, True)
        if x.type == D.INT and to == D.FLOAT:
            return replace(x, col=x.col.cast("double"), type=D.FLOAT)
        if x.type == D.TEXT and isinstance(x.value, str) and D.text_reads_as(x.value, to):
            return self.cast_text(x, to)
        if x.type.name == "Array" and to.name == "Array" and (not x.type.args or x.type.args[0] in (D.NULL, D.ANY)):
            return Typed(x.col.cast(D.spark_type(to)), to, None, x.constant)
        return None

    @staticmethod
    def cast_text(x: Typed, to: D.Type) -> Typed:
        if to == D.BOOL:
            low = F.lower(x.col)
            return Typed(F.when(low.isin(*D.TRUE_TEXTS), True).when(low.isin(*D.FALSE_TEXTS), False), D.BOOL, None, x.constant)
        if to == D.TIME:
            return replace(x, type=D.TIME, value=None)
        if to == D.DATETIME:
            return Typed(F.date_trunc("second", x.col.cast("timestamp")).cast("timestamp_ntz"), D.DATETIME, None, x.constant)
        return Typed(x.col.cast(_LITERALS[to]), to, None, x.constant)

    def pair(self, a: Typed, b: Typed) -> tuple[Typed, Typed]:
        """Both operands in one type: the right one is converted if it can be, else the left one."""
        right = self.implicit(b, a.type)
        if right is not None:
            return a, right
        left = self.implicit(a, b.type)
        if left is not None:
            return left, b
        raise Diagnostic(f"{a.type} and {b.type} do not go together")

    def boolean(self, tree: tuple, where: str) -> Column:
        x = self.lower(tree)
        y = self.implicit(x, D.BOOL)
        if y is None:
            raise Diagnostic(f"{where} needs a Boolean, not {x.type}")
        return y.col

    # ---- operators

    def _binary(self, op, left, right):
        a, b = self.lower(left), self.lower(right)
        constant = a.constant and b.constant
        out = lambda c, t: Typed(c, t, None, constant)
        if op in ("+", "-") and a.type == D.DATE and b.type == D.INT:
            days = b.col.cast("int")
            return out(F.date_add(a.col, days) if op == "+" else F.date_sub(a.col, days), D.DATE)
        if op in ("*", "/") and a.type == D.INTERVAL and b.type == D.INT:
            return out((fi.mul if op == "*" else fi.div)(a.col, b.col), D.INTERVAL)
        if op in ("||", "&&") and a.type.name == "Array" == b.type.name:
            return out(fa.overlap(a.col, b.col), D.BOOL)
        if op == "&&" and a.type.name == "Range" == b.type.name:
            return out(fr.overlap(a.col, b.col), D.BOOL)
        if op in ("@>", "<@"):
            if op == "<@":
                a, b = b, a
            if a.type.name == "Array":
                e = self.implicit(b, a.type.args[0]) if a.type.args else b
                if e is None:
                    raise Diagnostic(f"{a.type} can't contain {b.type}")
                return out(fa.contains(a.col, e.col), D.BOOL)
            if a.type.name == "Range":
                if b.type.name == "Range":
                    return out(fr.contains_range(a.col, b.col), D.BOOL)
                e = self.implicit(b, a.type.args[0])
                if e is None:
                    raise Diagnostic(f"{a.type} can't contain {b.type}")
                return out(fr.contains(a.col, e.col), D.BOOL)
            raise Diagnostic(f"{a.type} contains nothing")
        if op in ("||", "&&", "xor"):
            x, y = self.implicit(a, D.BOOL), self.implicit(b, D.BOOL)
            if x is None or y is None:
                raise Diagnostic(f"{op} needs Booleans, not {a.type} and {b.type}")
            return out({"||": x.col | y.col, "&&": x.col & y.col, "xor": x.col != y.col}[op], D.BOOL)
        a, b = self.pair(a, b)
        if a.type == D.INT:
            if op in ("<<", ">>"):
                return out(F.call_function("shiftleft" if op == "<<" else "shiftright", a.col, b.col.cast("int")), D.INT)
            made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: fn.int_div(a.col, b.col), "%": lambda: a.col % b.col, "^": lambda: fn.power(a.col, b.col), "|": lambda: a.col.bitwiseOR(b.col), "&": lambda: a.col.bitwiseAND(b.col), "#": lambda: a.col.bitwiseXOR(b.col)}.get(op)
            if made:
                return out(made(), D.INT)
        if a.type == D.FLOAT:
            made = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "/": lambda: fn.float_div(a.col, b.col)}.get(op)
            if made:
                return out(made(), D.FLOAT)
        if a.type == D.INTERVAL and op in ("+", "-"):
            return out((fi.add if op == "+" else fi.sub)(a.col, b.col), D.INTERVAL)
        raise Diagnostic(f"{op} is not defined for {a.type} and {b.type}")

    def _unary(self, op, tree):
        x = self.lower(tree)
        if op == "-" and x.type in (D.INT, D.FLOAT):
            return Typed(-x.col, x.type, -x.value if isinstance(x.value, (int, float)) else None, x.constant)
        if op in ("+", "~") and x.type == D.INT:
            return x if op == "+" else Typed(F.bitwise_not(x.col), D.INT, None, x.constant)
        raise Diagnostic(f"{op} is not defined for {x.type}")

    def _not(self, tree):
        x = self.implicit(self.lower(tree), D.BOOL)
        if x is None:
            raise Diagnostic("NOT needs a Boolean")
        return Typed(~x.col, D.BOOL, None, x.constant)

    @staticmethod
    def test(op: str, a: Column, b: Column) -> Column:
        return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "<=>": lambda: a.eqNullSafe(b)}[op]()

    def _compare(self, op, left, right):
        a, b = self.pair(self.lower(left), self.lower(right))
        if a.type.name in ("Row", "Composite", "Array", "Range", "DiffChanges") and op not in ("=", "!=", "<=>"):
            raise Diagnostic(f"{op} is not defined for {a.type}")
        x, y = a.col, b.col
        if a.type == D.INTERVAL and op not in ("=", "!=", "<=>"):
            x, y = fi.to_seconds(x), fi.to_seconds(y)
        return Typed(self.test(op, x, y), D.BOOL, None, a.constant and b.constant)

    def _quantified(self, op, quantifier, left, right):
        a, b = self.lower(left), self.lower(right)
        if b.type.name != "Array":
            raise Diagnostic("ALL and ANY need an array")
        x = self.implicit(a, b.type.args[0]) if b.type.args else a
        if x is None:
            raise Diagnostic(f"{a.type} can't be compared with elements of {b.type}")
        make = fa.all_ if quantifier == "all" else fa.any_
        return Typed(make(b.col, lambda e: self.test(op, x.col, e)), D.BOOL, None, a.constant and b.constant)

    def _texts(self, left, right):
        a, b = self.lower(left), self.lower(right)
        if a.type not in (D.TEXT, D.NULL) or b.type not in (D.TEXT, D.NULL):
            raise Diagnostic("pattern matching needs texts")
        return a, b

    def _like(self, left, right):
        a, b = self._texts(left, right)
        return Typed(fe.like(a.col, b.col), D.BOOL, None, a.constant and b.constant)

    def _glob(self, left, right):
        a, b = self._texts(left, right)
        return Typed(fe.glob(a.col, b.col), D.BOOL, None, a.constant and b.constant)

    def _regexp(self, left, right):
        a, b = self._texts(left, right)
        return Typed(fe.regexp(a.col, b.col), D.BOOL, None, a.constant and b.constant)

    def _is_null(self, tree, negated):
        x = self.lower(tree)
        return Typed(x.col.isNotNull() if negated else x.col.isNull(), D.BOOL, None, x.constant)

    def _in(self, tree, values, negated):
        x = self.lower(tree)
        if not values:
            return Typed(F.lit(negated), D.BOOL, negated, True)
        out, constant = None, x.constant
        literals: list = []
        for v in values:
            a, b = self.pair(x, self.lower(v))
            constant = constant and b.constant
            if b.value is not None and not isinstance(b.value, (list, tuple)) and a.col is x.col:
                literals.append(b.col)
                continue
            one = a.col.eqNullSafe(b.col)  # a null is found by a null
            out = one if out is None else out | one
        if literals:
            among = F.coalesce(x.col.isin(*literals), F.lit(False))
            out = among if out is None else out | among
        return Typed(~out if negated else out, D.BOOL, None, constant)

    def _between(self, tree, low, high, symmetric):
        x = self.lower(tree)
        a, b = self.pair(x, self.lower(low))[1], self.pair(x, self.lower(high))[1]
        v, lo, hi = x.col, a.col, b.col
        if x.type == D.INTERVAL:
            v, lo, hi = (fi.to_seconds(c) for c in (v, lo, hi))
        if x.type == D.INT and D.FLOAT in (a.type, b.type):
            v = v.cast("double")
        if symmetric:
            lo, hi = F.least(lo, hi), F.greatest(lo, hi)
        return Typed(v.between(lo, hi), D.BOOL, None, x.constant and a.constant and b.constant)

    def _case(self, branches, default):
        values = [self.lower(v) for _, v in branches] + [self.lower(default)]
        t = next((v.type for v in values if v.type != D.NULL), D.NULL)
        if t == D.INT and any(v.type == D.FLOAT for v in values):
            t = D.FLOAT
        fitted = [self.implicit(v, t) for v in values]
        if any(v is None for v in fitted):
            raise Diagnostic("The values of CASE have different types")
        out = None
        for (c, _), v in zip(branches, fitted, strict=False):
            test = self.boolean(c, "WHEN")
            out = F.when(test, v.col) if out is None else out.when(test, v.col)
        return Typed(out.otherwise(fitted[-1].col), t)

    def _cast(self, tree, name):
        x = self.lower(tree)
        base = D.CAST_NAMES.get(name.rstrip("[]"))
        if base is None:
            raise Diagnostic(f"No type is named {name!r}", None, did_you_mean(name, D.CAST_NAMES))
        to = base
        for _ in range(name.count("[]")):
            to = D.array(to)
        same = self.implicit(x, to)
        if same is not None:
            return replace(same, value=None)
        a = x.type
        if (a, to) in ((D.INT, D.BOOL), (D.BOOL, D.INT)):
            return Typed(x.col.cast(_LITERALS[to]), to, None, x.constant)
        if (a, to) == (D.FLOAT, D.INT):
            return Typed(x.col.cast("bigint"), to, None, x.constant)
        if (a, to) in ((D.DATE, D.DATETIME), (D.DATETIME, D.DATE)):
            return Typed(x.col.cast(_LITERALS[to]), to, None, x.constant)
        if a == D.TEXT and isinstance(x.value, str):
            for middle in (D.BOOL, D.DATE, D.DATETIME):  # a text literal may take one step more
                if D.text_reads_as(x.value, middle) and (middle, to) in ((D.BOOL, D.INT), (D.DATE, D.DATETIME), (D.DATETIME, D.DATE)):
                    return Typed(self.cast_text(x, middle).col.cast(_LITERALS[to]), to, None, True)
        raise Diagnostic(f"{a} can't be cast to {to}")

    def _index(self, tree, i):
        a, n = self.lower(tree), self.lower(i)
        if a.type.name != "Array" or n.type != D.INT:
            raise Diagnostic("an index needs an array and an Int")
        if isinstance(n.value, int) and n.value < 1:
            raise Diagnostic("array indexes start at 1")
        return Typed(fa.element(a.col, n.col), a.type.args[0])

    def _slice(self, tree, start, end):
        a = self.lower(tree)
        if a.type.name != "Array":
            raise Diagnostic("a slice needs an array")
        bounds = [None if b is None else self.lower(b) for b in (start, end)]
        if any(b is not None and b.type != D.INT for b in bounds):
            raise Diagnostic("slice bounds are Int")
        return Typed(fa.slice_(a.col, *(None if b is None else b.col for b in bounds)), a.type)

    def _member(self, tree, name):
        x = self.lower(tree)
        if x.type.name != "Composite":
            raise Diagnostic(f"{x.type} has no members")
        for member, t in x.type.args:
            if member == name:
                return Typed(x.col.getField(name), t)
        raise Diagnostic(f"no member is named {name!r}", None, did_you_mean(name, [m for m, _ in x.type.args]))

    def _row(self, items):
        xs = [self.lower(i) for i in items]
        return Typed(F.struct(*(x.col.alias(f"c{k}") for k, x in enumerate(xs))), D.Type("Row", tuple(x.type for x in xs)), None, all(x.constant for x in xs))

    def _array(self, items):
        xs = [self.lower(i) for i in items]
        if not xs:
            return Typed(F.array().cast("array<string>"), D.array(D.ANY), None, True)
        t = next((x.type for x in xs if x.type != D.NULL), D.NULL)
        if t == D.INT and any(x.type == D.FLOAT for x in xs):
            t = D.FLOAT
        fitted = [self.implicit(x, t) for x in xs]
        if any(x is None for x in fitted):
            raise Diagnostic("array elements have different types")
        return Typed(F.array(*(x.col for x in fitted)), D.array(t), None, all(x.constant for x in xs))

    def _benchmark(self, n, e):
        if self.lower(n).type != D.INT:
            raise Diagnostic("BENCHMARK needs a count")
        self.lower(e)
        return Typed(F.lit(0).cast("bigint"), D.INT)

    def _assign(self, name, tree):
        x = self.lower(tree)
        if not x.constant:
            raise Diagnostic("only constants can be assigned inside a query")
        self.lowering.assign(name, x)
        return self.lowering.variables[name]

    def _call(self, name, args, over, at):
        if name in AGGREGATES or name in WINDOWS or name in self.lowering.aggregates or name in self.lowering.windows:
            raise Diagnostic(f"{name.upper()} can't be used here", at)
        fn_ = self.lowering.functions.get(name)
        if fn_ is None:
            raise Diagnostic(f"No function is named {name!r}", at, did_you_mean(name, [*self.lowering.functions, *AGGREGATES, *WINDOWS]))
        if over is not None:
            raise Diagnostic(f"{name.upper()} is no window function", at)
        return self.apply(name, fn_, [self.lower(a) for a in args], at)

    def apply(self, name: str, f: Function, xs: list[Typed], at=None) -> Typed:
        params = list(f.params)
        least = sum(not p.endswith(("?", "*")) for p in params)
        if len(xs) < least or (len(xs) > len(params) and not (params and params[-1].endswith("*"))):
            raise Diagnostic(f"{name.upper()} takes {least if least == len(params) else f'{least} or more'} arguments, not {len(xs)}", at)
        fitted: list[Typed] = []
        for k, x in enumerate(xs):
            kind = params[min(k, len(params) - 1)].rstrip("?*")
            y = self.fit(x, kind, fitted)
            if y is None:
                raise Diagnostic(f"argument {k + 1} of {name.upper()} is {x.type}, expected {kind}", at)
            fitted.append(y)
        result = f.result(*(x.type for x in fitted)) if callable(f.result) else f.result
        return Typed(f.build(*fitted), result, None, False)

    def fit(self, x: Typed, kind: str, before: list[Typed]) -> Typed | None:
        if kind == "Any":
            return x
        if kind == "Num":
            return x if x.type in (D.INT, D.FLOAT) else None
        if kind == "DateLike":
            return x if x.type in (D.DATE, D.DATETIME) else self.implicit(x, D.DATE) or self.implicit(x, D.DATETIME)
        if kind in ("Array", "Range", "DiffChanges"):
            return x if x.type.name == kind else None
        if kind == "Same":
            return self.implicit(x, before[0].type)
        if kind == "Elem":
            return self.implicit(x, before[0].type.args[0])
        if kind == "Date" and x.type == D.DATETIME:
            return Typed(F.to_date(x.col), D.DATE)
        return self.implicit(x, D.Type(kind))

    # ---- aggregates

    def aggregate(self, name: str, args: list[tuple]) -> Typed:
        xs = [self.lower(a) for a in args]
        custom = self.lowering.aggregates.get(name)
        if custom is not None:
            return self.apply(name, custom, xs)
        if name == "count":
            if len(xs) > 1:
                raise Diagnostic("COUNT takes at most one argument")
            return Typed(ag.count(), D.INT)
        if name == "group_concat" and xs:
            return Typed(ag.group_concat(*(x.text() for x in xs)), D.TEXT)
        if len(xs) != 1:
            raise Diagnostic(f"{name.upper()} takes one argument")
        x = xs[0]
        if name in ("max", "min") and x.type in (D.INT, D.FLOAT, D.TEXT, D.DATE, D.TIME, D.DATETIME):
            return Typed((ag.max_ if name == "max" else ag.min_)(x.col), x.type)
        if name == "sum" and x.type in (D.INT, D.FLOAT):
            return Typed(ag.sum_(x.col).cast(_LITERALS[x.type]), x.type)
        if name == "avg" and x.type in (D.INT, D.FLOAT):
            return Typed(ag.avg_int(x.col) if x.type == D.INT else ag.avg(x.col), x.type)
        if name in ("bool_and", "bool_or") and x.type == D.BOOL:
            return Typed((ag.bool_and if name == "bool_and" else ag.bool_or)(x.col), D.BOOL)
        if name in ("bit_and", "bit_or", "bit_xor") and x.type == D.INT:
            return Typed({"bit_and": ag.bit_and, "bit_or": ag.bit_or, "bit_xor": ag.bit_xor}[name](x.col), D.INT)
        if name == "array_agg":
            return Typed(ag.array_agg(x.col), D.array(x.type))
        raise Diagnostic(f"{name.upper()} is not defined for {x.type}")


class Lowering:
    def __init__(self, catalog, functions: dict[str, Function], aggregates: dict[str, Function], windows: dict, variables: dict[str, Typed], spark) -> None:
        self.catalog, self.functions, self.aggregates, self.windows, self.variables, self.spark = catalog, functions, aggregates, windows, variables, spark

    def is_aggregate(self, c) -> bool:
        return (c[1] in AGGREGATES or c[1] in self.aggregates) and c[3] is None

    def is_window(self, c) -> bool:
        return c[3] is not None and (c[1] in AGGREGATES or c[1] in WINDOWS or c[1] in self.aggregates or c[1] in self.windows)

    def evaluate(self, trees: list[tuple]) -> list:
        """Values of constant expressions, through a one-row DataFrame."""
        scope = Scope(self, {})
        for t in trees:
            if calls(t, lambda c: self.is_aggregate(c) or c[1] in WINDOWS):
                raise Diagnostic("aggregates can't be used here")
        xs = [scope.lower(t) for t in trees]
        row = self.spark.range(1).select(*(x.col.alias(f"c{k}") for k, x in enumerate(xs))).first()
        return list(zip(row, xs, strict=True))

    def assign(self, name: str, x: Typed) -> None:
        value = self.spark.range(1).select(x.col.alias("v")).first()[0]
        self.variables[name] = self.literal(value, x.type)

    def literal(self, value, t: D.Type) -> Typed:
        if t == D.NULL or t.name in ("Row", "Composite", "DiffChanges"):
            return Typed(F.lit(None) if value is None else F.lit(value), t, value, True)
        if isinstance(value, dt.datetime):
            return Typed(F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), t, None, True)
        if t == D.INTERVAL and value is not None:
            return Typed(fi.make(**value.asDict()), t, None, True)
        if t.name == "Range" and value is not None:
            return Typed(fr.make(*(F.lit(v) for v in value)).cast(D.spark_type(t)), t, None, True)
        if isinstance(value, list):
            return Typed(F.array(*(self.literal(v, t.args[0]).col for v in value)).cast(D.spark_type(t)), t, None, True)
        return Typed(F.lit(value).cast(D.spark_type(t)), t, value, True)

    # ---------------------------------------------------------------- SELECT

    def source(self, q: Select) -> tuple[DataFrame, dict[str, Typed]]:
        if q.table is None:
            return self.spark.range(1).select(), {}
        used = None if q.star else set(all_names(q))
        df, columns = self.catalog.get(q.table, used)
        for j in q.joins:
            right, more = self.catalog.get(j.table, used)
            renamed = {}
            for name in right.columns:
                if name in df.columns:
                    renamed[name] = f"__{j.table}_{name}"
                    right = right.withColumnRenamed(name, renamed[name])
            merged = dict(columns) | {n: t for n, t in more.items() if n not in columns}
            scope = Scope(self, {n: Typed(F.col(f"`{n}`"), t) for n, t in merged.items()})
            # A name both tables have means the first one, except that `name = name` joins on both.
            condition = self._on(scope, j.on, columns, more, renamed) if j.on is not None else None
            how = {"default": "inner", "inner": "inner", "cross": "inner", "left": "left", "right": "right"}[j.kind]
            df = df.crossJoin(right) if condition is None else df.join(right, condition, how)
            columns = merged
        return df, {n: Typed(F.col(f"`{n}`"), t) for n, t in columns.items()}

    @staticmethod
    def _on(scope: Scope, on: tuple, columns, more, renamed) -> Column:
        if on[0] == "compare" and on[1] == "=" and on[2][0] == on[3][0] == "column" and on[2][1] == on[3][1] and on[2][1] in columns and on[2][1] in renamed:
            return F.col(f"`{on[2][1]}`") == F.col(f"`{renamed[on[2][1]]}`")
        return scope.boolean(on, "ON")

    def select(self, q: Select) -> tuple[DataFrame, dict[str, D.Type]]:
        df, base = self.source(q)
        if q.star:
            if q.table is None:
                raise Diagnostic("SELECT * needs FROM")
            items = [(("column", n, None), n) for n in base]
        else:
            items, number = [], 0
            for tree, alias in q.items:
                if alias is None and tree[0] == "column":
                    alias = tree[1]
                elif alias is None:
                    alias = f"column_{number}"
                    number += 1
                elif alias in base and not (tree[0] == "column" and tree[1] == alias):
                    raise Diagnostic(f"the alias {alias!r} is a column's name")
                items.append((tree, alias))
            plain = [t[1] for t, a in items if t[0] == "column"]
            if len(set(plain)) < len(plain):
                raise Diagnostic("a column is selected twice")
        if len({a for _, a in items}) < len(items):
            raise Diagnostic("two results have the same name")
        aliases = {a: t for t, a in items if not (t[0] == "column" and t[1] == a)}
        windowed = {key(c): c for t, _ in items for c in calls(t, self.is_window)}
        for part in (q.where, q.group, q.having, q.qualify, [o.expr for o in q.order]):
            if part is not None and calls(part, self.is_window):
                raise Diagnostic("window functions can only be called in the SELECT list")
        for c in windowed.values():
            if calls(c[2], lambda x: self.is_window(x)):
                raise Diagnostic("window functions can't be nested")
        if q.where is not None:
            seen = [q.where, *(aliases[n] for n in names_in(q.where) if n in aliases)]
            if calls(seen, self.is_aggregate):
                raise Diagnostic("aggregates can't be used in WHERE")
            df = df.where(Scope(self, base, aliases).boolean(q.where, "WHERE"))
        scope = Scope(self, base, aliases)
        wanted = [t for t, _ in items] + [q.having, [o.expr for o in q.order], *(c[2] for c in windowed.values())]
        aggregates = {key(c): c for c in calls(wanted, self.is_aggregate)}
        for c in aggregates.values():
            if calls(c[2], self.is_aggregate):
                raise Diagnostic("aggregates can't be nested")
        if aggregates and q.table is None:
            raise Diagnostic("aggregates need a table")
        if q.group or aggregates:
            df, scope = self._grouped(q, df, base, aliases, items, aggregates, windowed)
            if q.having is not None:
                df = df.where(scope.boolean(q.having, "HAVING"))
        if windowed:
            df, scope = self._windowed(q, df, scope, windowed)
        if q.qualify is not None:
            df = df.where(scope.boolean(q.qualify, "QUALIFY"))
        results = [(scope.lower(t), a) for t, a in items]
        schema = {a: x.type for x, a in results}
        order = [(scope.lower(o.expr), o) for o in q.order]
        keys = [(x, o) for x, o in order if not x.constant]
        sort_col = lambda x: fi.to_seconds(x.col) if x.type == D.INTERVAL else x.col
        distinct_on = [scope.lower(("column", n, None)) for n in q.distinct_on]
        work = df.select(*(x.col.alias(f"__r{k}") for k, (x, _) in enumerate(results)), *(sort_col(x).alias(f"__s{k}") for k, (x, _) in enumerate(keys)), *(x.col.alias(f"__d{k}") for k, x in enumerate(distinct_on)))
        ordering = [self._order(F.col(f"__s{k}"), o) for k, (_, o) in enumerate(keys)]
        if q.distinct:
            work = work.dropDuplicates([f"__r{k}" for k in range(len(results))])
        if distinct_on:
            # Ties are broken by the values themselves, so the choice does not depend on the order of rows.
            ties = [F.col(f"__r{k}").asc_nulls_last() for k, (x, _) in enumerate(results) if x.type.name not in ("Interval", "Row", "Composite", "DiffChanges", "Null", "Range")]
            spec = Window.partitionBy(*(f"__d{k}" for k in range(len(distinct_on)))).orderBy(*ordering, *ties)
            work = work.withColumn("__n", F.row_number().over(spec)).where(F.col("__n") == 1)
        if ordering:
            work = work.orderBy(*ordering)
        if q.offset is not None:
            value = self.evaluate([q.offset])[0][0]
            if value is not None and not isinstance(value, int):
                raise Diagnostic("OFFSET needs an Int")
            if value:
                work = work.offset(value)
        if q.limit is not None:
            work = work.limit(q.limit)
        return work.select(*(F.col(f"__r{k}").alias(a) for k, (_, a) in enumerate(results))), schema

    @staticmethod
    def _order(c: Column, o) -> Column:
        if o.descending:
            return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()

    def _grouped(self, q, df, base, aliases, items, aggregates, windowed):
        scope = Scope(self, base, aliases)
        keys = []
        for k, tree in enumerate(q.group):
            x = scope.lower(tree)
            keys.append((tree, x, f"__k{k}"))
        given: dict[str, Typed] = {}
        for tree, x, name in keys:
            one = Typed(F.col(name), x.type)
            given[key(tree)] = one
            if tree[0] == "column" and tree[1] in aliases:
                given[key(aliases[tree[1]])] = one
        outs = []
        for k, (sign, c) in enumerate(aggregates.items()):
            x = scope.aggregate(c[1], c[2])
            outs.append(x.col.alias(f"__a{k}"))
            given[sign] = Typed(F.col(f"__a{k}"), x.type)
        # Other columns take the value of the group's first row.
        rest = [t for t, _ in items] + [q.having, q.qualify, [o.expr for o in q.order], *[aliases[n] for n in aliases], [c[2] for c in windowed.values()], *[c[3] for c in windowed.values()], *q.windows.values()]
        used = dict.fromkeys(n for t in rest for n in names_in(t) if n in base)
        columns = {}
        for k, n in enumerate(used):
            hit = given.get(f"column:{n}")
            if hit is not None:
                columns[n] = hit
                continue
            outs.append(_of_least_row(base, n).alias(f"__c{k}"))
            columns[n] = Typed(F.col(f"__c{k}"), base[n].type)
        grouped = [x.col.alias(name) for _, x, name in keys]
        if not keys:
            df = df.agg(*(outs or [F.count(F.lit(1)).alias("__n")]))
        else:
            groups = df.rollup(*grouped) if q.rollup else df.groupBy(*grouped)
            df = groups.agg(*(outs or [F.count(F.lit(1)).alias("__n")]))
        return df, Scope(self, columns, aliases, given)

    def _place_of_whole_table(self, df, scope, c, over):
        """FIRST_VALUE, LAST_VALUE or NTH_VALUE over a whole ordered table: a top-k of one row, joined to all; None if it is not one of these."""
        name, args = c[1], c[2]
        if name in self.windows or (name, len(args)) not in (("first_value", 1), ("last_value", 1), ("nth_value", 2)):
            return None
        items = [_flipped(o) if name == "last_value" else o for o in over.order]
        order = [(scope.lower(o.expr), o) for o in items]
        by = [self._order(fi.to_seconds(x.col) if x.type == D.INTERVAL else x.col, o) for x, o in order if not x.constant]
        value = scope.lower(args[0])
        n = scope.lower(args[1]).value if name == "nth_value" else 1
        if not by or not isinstance(n, int) or n < 1:
            return None
        one = df.orderBy(*by).select(value.col.alias("__v")).offset(n - 1).limit(1)
        return one.agg(F.first("__v").alias("__v")), value.type

    def _windowed(self, q, df, scope, windowed):
        given = dict(scope.given)
        columns = dict(scope.columns)
        for k, (sign, c) in enumerate(windowed.items()):
            over = c[3]
            if isinstance(over, str):
                if over not in q.windows:
                    raise Diagnostic(f"no window is named {over!r}")
                over = q.windows[over]
            if over.partition is None and not over.order and (c[1] in AGGREGATES or c[1] in self.aggregates):
                # Over the whole table: one aggregated row, joined to all; no task holds the table.
                x = scope.aggregate(c[1], c[2])
                one = df.agg(x.col.alias(f"__w{k}"))
                df = df.crossJoin(F.broadcast(one))
                given[sign] = Typed(F.col(f"__w{k}"), x.type)
                continue
            if over.partition is None and c[1] == "row_number" and not c[2]:
                order = [(scope.lower(o.expr), o) for o in over.order]
                by = [self._order(fi.to_seconds(x.col) if x.type == D.INTERVAL else x.col, o) for x, o in order if not x.constant]
                df = numbered(df, by, f"__w{k}")
                given[sign] = Typed(F.col(f"__w{k}"), D.INT)
                continue
            placed = self._place_of_whole_table(df, scope, c, over) if over.partition is None else None
            if placed is not None:
                one, t = placed
                df = df.crossJoin(F.broadcast(one.withColumnRenamed("__v", f"__w{k}")))
                given[sign] = Typed(F.col(f"__w{k}"), t)
                continue
            spec = Window.partitionBy(*([scope.lower(over.partition).col] if over.partition is not None else [F.lit(1)]))
            order = [(scope.lower(o.expr), o) for o in over.order]
            name = c[1]
            ordered = spec.orderBy(*(self._order(fi.to_seconds(x.col) if x.type == D.INTERVAL else x.col, o) for x, o in order if not x.constant)) if order else spec.orderBy(F.lit(1))
            if name in AGGREGATES or name in self.aggregates:
                x = scope.aggregate(name, c[2])
                made = Typed(_over(scope, name, c[2], x, fw.whole(spec)), x.type)
            elif name in self.windows:
                made = self.windows[name](scope, c[2], ordered)
            else:
                xs = [scope.lower(a) for a in c[2]]
                need = {"row_number": 0, "first_value": 1, "last_value": 1, "nth_value": 2}[name]
                if len(xs) != need:
                    raise Diagnostic(f"{name.upper()} takes {need} arguments")
                if name == "row_number":
                    made = Typed(fw.row_number(ordered), D.INT)
                elif name == "nth_value":
                    if not isinstance(xs[1].value, int):
                        raise Diagnostic("NTH_VALUE needs a literal position")
                    made = Typed(fw.nth_value(xs[0].col, xs[1].value, ordered), xs[0].type)
                else:
                    made = Typed((fw.first_value if name == "first_value" else fw.last_value)(xs[0].col, ordered), xs[0].type)
            df = df.withColumn(f"__w{k}", made.col)
            given[sign] = Typed(F.col(f"__w{k}"), made.type)
        return df, Scope(self, columns, scope.aliases, given)


def _flipped(o):
    """The opposite order, nulls included."""
    return replace(o, descending=not o.descending, nulls_first=not o.nulls_first)


def _of_least_row(base: dict[str, Typed], name: str) -> Column:
    """The column's value in the group's least row, by the values of all columns that have an order: it does not depend on the order of rows."""
    whole = [x.col for x in base.values() if x.type.name not in ("Interval", "Row", "Composite", "DiffChanges", "Null", "Range", "Array")]
    value = base[name].col
    return F.min_by(F.struct(value.alias("v")), F.struct(*whole))["v"] if whole else F.first(value)


def _over(scope: Scope, name: str, args: list[tuple], x: Typed, spec) -> Column:
    """An aggregate over a whole partition; composed ones are built around their windowed parts."""
    xs = [scope.lower(a) for a in args]
    c = xs[0].col if xs else None
    if name == "count":
        return F.count(F.lit(1)).over(spec)
    if name == "sum":
        return F.coalesce(F.sum(c).over(spec), F.lit(0)).cast(_LITERALS[x.type])
    if name == "avg" and x.type == D.INT:
        s, n = F.sum(c).over(spec), F.count(c).over(spec)
        return F.when(n > 0, (s - s % F.when(n > 0, n)) / n).cast("bigint")
    if name in ("bool_and", "bool_or"):
        return F.coalesce((F.bool_and if name == "bool_and" else F.bool_or)(c).over(spec), F.lit(name == "bool_and"))
    if name == "group_concat":
        text = F.concat(*(F.coalesce(y.text(), F.lit("Null")) for y in xs))
        return F.array_join(F.array_sort(F.collect_list(text).over(spec)), "")
    if name == "array_agg":
        return F.transform(F.array_sort(F.collect_list(F.struct(c.alias("v"))).over(spec)), lambda s: s["v"])
    return x.col.over(spec)
