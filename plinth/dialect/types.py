"""Types of the dialect and the rules between them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from plinth.functions.interval import TYPE as INTERVAL_STRUCT


@dataclass(frozen=True)
class Type:
    name: str
    args: tuple = ()

    def __str__(self) -> str:
        return self.name + (f"({', '.join(map(str, self.args))})" if self.args else "")


INT, FLOAT, TEXT, BOOL = Type("Int"), Type("Float"), Type("Text"), Type("Boolean")
DATE, TIME, DATETIME, INTERVAL = Type("Date"), Type("Time"), Type("DateTime"), Type("Interval")
NULL, ANY, DIFFS = Type("Null"), Type("Any"), Type("DiffChanges")

#: Type names a cast accepts.
CAST_NAMES = {"integer": INT, "int": INT, "real": FLOAT, "float": FLOAT, "boolean": BOOL, "bool": BOOL, "text": TEXT, "date": DATE, "time": TIME, "datetime": DATETIME, "interval": INTERVAL}
#: Texts that read as booleans.
TRUE_TEXTS, FALSE_TEXTS = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_TIME = re.compile(r"^\d{1,2}:\d{2}:\d{2}(?:\.\d{1,3})?$")
_DATETIME = re.compile(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}:\d{2}(?:\.\d{1,3})?$")


def array(of: Type) -> Type:
    return Type("Array", (of,))


def range_(of: Type) -> Type:
    return Type("Range", (of,))


def spark_type(t: Type) -> T.DataType:
    simple = {"Int": T.LongType(), "Float": T.DoubleType(), "Text": T.StringType(), "Boolean": T.BooleanType(), "Date": T.DateType(), "Time": T.StringType(), "DateTime": T.TimestampNTZType(), "Interval": INTERVAL_STRUCT, "Null": T.NullType()}
    if t.name in simple:
        return simple[t.name]
    if t.name == "Array":
        return T.ArrayType(spark_type(t.args[0]))
    if t.name == "Range":
        return T.StructType([T.StructField("lower", spark_type(t.args[0])), T.StructField("upper", spark_type(t.args[0]))])
    raise ValueError(f"no storage for {t}")


def from_spark(d: T.DataType) -> Type:
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(d, T.BooleanType):
        return BOOL
    if isinstance(d, T.DateType):
        return DATE
    if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(d, T.NullType):
        return NULL
    if isinstance(d, T.ArrayType):
        if isinstance(d.elementType, T.StructType) and {"location", "content", "kind"} <= set(d.elementType.names):
            return DIFFS
        return array(from_spark(d.elementType))
    if isinstance(d, T.StructType):
        if d.names == INTERVAL_STRUCT.names:
            return INTERVAL
        if d.names == ["lower", "upper"]:
            return range_(from_spark(d["lower"].dataType))
        return Type("Composite", tuple((f.name, from_spark(f.dataType)) for f in d))
    return TEXT


def normal(d: T.DataType) -> T.DataType:
    """Storage of a column once registered: one width for whole and one for real numbers."""
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    if isinstance(d, (T.FloatType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(d, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(d, T.ArrayType) and from_spark(d) != DIFFS:
        return T.ArrayType(normal(d.elementType))
    return d


def text_reads_as(text: str, to: Type) -> bool:
    if to == BOOL:
        return text.lower() in TRUE_TEXTS + FALSE_TEXTS
    pattern = {"Date": _DATE, "Time": _TIME, "DateTime": _DATETIME}.get(to.name)
    return bool(pattern and pattern.match(text))
