"""Results as text files and as text on a terminal.

Rows are streamed to the driver partition by partition (``toLocalIterator``): the reference's sinks
write one file, and a single file needs a single writer.  ``write_distributed`` writes the same text
in parallel, as a folder, for results too large for that.
"""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.dialect import types as D
from plinth.functions import interval as fi


def shown(name: str, t: D.Type | None) -> Column:
    c = F.col(f"`{name}`")
    if t == D.INTERVAL:
        c = fi.show(c)
    elif t == D.DATETIME:
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(c.cast("string"), F.lit("Null")).alias(name)


def as_text(df: DataFrame, types: dict[str, D.Type] | None = None) -> DataFrame:
    return df.select(*(shown(n, (types or {}).get(n)) for n in df.columns))


def _enclosed(values, mark: str) -> list[str]:
    return [f"{mark}{v}{mark}" for v in values]


def write_text(df: DataFrame, types, options: dict) -> None:
    """INTO OUTFILE / DUMPFILE: header and rows, one file, replaced; nothing is escaped."""
    text = as_text(df, types)
    with open(options["path"], "w", encoding="utf-8", newline="") as f:
        f.write(options["fields"].join(_enclosed(text.columns, options["enclosed"])) + options["lines"])
        for row in text.toLocalIterator():
            f.write(options["fields"].join(_enclosed(row, options["enclosed"])) + options["lines"])


def write_distributed(df: DataFrame, types, path: str, fields: str = ",", enclosed: str = "") -> None:
    """The rows as text files in a folder, written by all executors."""
    text = as_text(df, types)
    cells = [F.concat(F.lit(enclosed), F.col(f"`{c}`"), F.lit(enclosed)) for c in text.columns]
    text.select(F.concat_ws(fields, *cells).alias("value")).write.mode("overwrite").text(path)


def csv_text(df: DataFrame, types=None) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    for row in as_text(df, types).toLocalIterator():
        w.writerow(row)
    return out.getvalue()


def json_text(df: DataFrame, types=None) -> str:
    """An array of objects; every value is a text."""
    return json.dumps([r.asDict() for r in as_text(df, types).toLocalIterator()], ensure_ascii=False)


def yaml_text(df: DataFrame, types=None) -> str:
    lines = []
    for r in as_text(df, types).toLocalIterator():
        for k, (n, v) in enumerate(r.asDict().items()):
            lines.append(("- " if k == 0 else "  ") + f"{n}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(lines) + ("\n" if lines else "")


def table_text(df: DataFrame, types=None, page_size: int | None = None, page: int = 1) -> str:
    """A box with all rows, or one page of them."""
    text = as_text(df, types)
    if page_size:
        text = text.offset((page - 1) * page_size).limit(page_size)
    rows = [tuple(r) for r in text.toLocalIterator()]
    widths = [max([len(c), *(len(line) for r in rows for line in r[k].split("\n"))]) for k, c in enumerate(text.columns)]
    bar = lambda a, b, c, d: a + c.join(b * (w + 2) for w in widths) + d

    def cells(row) -> list[str]:
        parts = [v.split("\n") for v in row]
        return ["│" + "┆".join(f" {(p[n] if n < len(p) else ''):<{w}} " for p, w in zip(parts, widths, strict=True)) + "│" for n in range(max(map(len, parts)))]

    out = [bar("╭", "─", "┬", "╮"), *cells(text.columns), bar("╞", "═", "╪", "╡")]
    for k, r in enumerate(rows):
        if k:
            out.append(bar("├", "╌", "┼", "┤"))
        out += cells(r)
    return "\n".join([*out, bar("╰", "─", "┴", "╯")]) + "\n"
