"""The session: tables, functions, variables and statements of the dialect."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plinth.dialect import types as D
from plinth.dialect.diagnostics import Diagnostic, did_you_mean
from plinth.dialect.lower import Lowering, Typed
from plinth.dialect.parser import parse
from plinth.dialect.registry import SCALAR, Function


@dataclass
class Result:
    """What a statement gave: a DataFrame with the dialect's types, or nothing (SET, DO, INTO)."""

    kind: str
    df: DataFrame | None = None
    types: dict[str, D.Type] | None = None


class Catalog:
    """Tables by name.  A column name has one type over all tables."""

    def __init__(self) -> None:
        self.tables: dict[str, tuple[Callable[[], DataFrame] | DataFrame, dict[str, D.Type] | None]] = {}
        self.column_types: dict[str, D.Type] = {}
        self.providers: dict[str, Callable[..., DataFrame]] = {}

    @staticmethod
    def _normal(df: DataFrame) -> DataFrame:
        return df.select(*(df[f"`{f.name}`"].cast(D.normal(f.dataType)).alias(f.name) for f in df.schema))

    def put(self, name: str, source) -> None:
        if not isinstance(source, DataFrame) and "columns" in inspect.signature(source).parameters:
            self.providers[name.lower()] = source
        else:
            self.providers.pop(name.lower(), None)
        self.tables[name.lower()] = (source, None)
        if isinstance(source, DataFrame):
            self.get(name.lower())

    def get(self, name: str, used: set[str] | None = None) -> tuple[DataFrame, dict[str, D.Type]]:
        """The table and its types.  A provider that takes ``columns`` is told the names a query uses and may leave the others null."""
        if name in self.tables and used is not None:
            provider = self.providers.get(name)
            if provider is not None:
                types = self.get(name)[1]
                return self._normal(provider(columns=used & set(types))), types
        if name not in self.tables:
            raise Diagnostic(f"No table is named {name!r}", None, did_you_mean(name, self.tables))
        source, types = self.tables[name]
        if types is None:
            df = self._normal(source() if callable(source) and not isinstance(source, DataFrame) else source)
            types = {f.name: D.from_spark(f.dataType) for f in df.schema}
            for c, t in types.items():
                if self.column_types.setdefault(c, t) != t:
                    raise Diagnostic(f"the column {c!r} is {self.column_types[c]} elsewhere and {t} in {name!r}")
            self.tables[name] = source, types = df, types
        return source, types


class Session:
    """Statements over registered tables; variables and functions live as long as the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.catalog = Catalog()
        self.functions: dict[str, Function] = dict(SCALAR)
        self.aggregates: dict[str, Function] = {}
        self.windows: dict = {}
        self.variables: dict[str, Typed] = {}

    # ---------------------------------------------------------------- registration

    def register_table(self, name: str, source) -> Session:
        """``source``: a DataFrame, or a function that gives one when the table is first used.  If it takes
        ``columns``, each query passes the set of columns it uses."""
        self.catalog.put(name, source)
        return self

    def register_parquet(self, sf_dir: str, *names: str) -> Session:
        from plinth.sources.tables import table

        for n in names:
            self.register_table(n, lambda n=n: table(self.spark, sf_dir, n))
        return self

    def register_union(self, name: str, sources: list[DataFrame]) -> Session:
        """Several sources of one table, rows of all."""
        df = sources[0]
        for s in sources[1:]:
            df = df.unionByName(s)
        return self.register_table(name, df)

    def register_function(self, name: str, params: str, result: D.Type, build: Callable) -> Session:
        """``build`` takes and gives Columns; ``params`` are kinds as in ``dialect.registry``."""
        self.functions[name.lower()] = Function(tuple(params.split()), result, lambda *a: build(*(x.col for x in a)))
        return self

    def register_aggregate(self, name: str, params: str, result: D.Type, build: Callable) -> Session:
        self.aggregates[name.lower()] = Function(tuple(params.split()), result, lambda *a: build(*(x.col for x in a)))
        return self

    def register_window(self, name: str, result: D.Type, build: Callable) -> Session:
        """``build`` takes the argument Columns and a window specification."""
        self.windows[name.lower()] = lambda scope, args, spec: Typed(build([scope.lower(a).col for a in args], spec), result)
        return self

    # ---------------------------------------------------------------- statements

    def sql(self, text: str) -> list[Result]:
        return [self._run(s) for s in parse(text)]

    def query(self, text: str) -> DataFrame:
        """The DataFrame of the last statement that has one."""
        return [r for r in self.sql(text) if r.df is not None][-1].df

    def _lowering(self) -> Lowering:
        return Lowering(self.catalog, self.functions, self.aggregates, self.windows, self.variables, self.spark)

    def _run(self, statement: tuple) -> Result:
        kind = statement[0]
        if kind == "select":
            q = statement[1]
            df, types = self._lowering().select(q)
            if q.into:
                from plinth.sources.sinks import write_text

                write_text(df, types, q.into)
                return Result("into")
            return Result("select", df, types)
        if kind == "set":
            (value, x) = self._lowering().evaluate([statement[2]])[0]
            self.variables[statement[1]] = self._lowering().literal(value, x.type)
            return Result("set")
        if kind == "do":
            self._lowering().evaluate(statement[1])
            return Result("do")
        if kind == "show":
            return Result("show", self.spark.createDataFrame([(t,) for t in sorted(self.catalog.tables)], "Tables string"), {"Tables": D.TEXT})
        df, types = self.catalog.get(statement[1])
        return Result("describe", self.spark.createDataFrame([(c, str(types[c])) for c in df.columns], "field string, type string"), {"field": D.TEXT, "type": D.TEXT})
