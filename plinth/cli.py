"""Command line: python -m plinth.cli --repos DIR -q "SELECT ..." (or -s FILE, or no query for a prompt)."""

from __future__ import annotations

import os
import sys
import time
from dataclasses import dataclass, field

USAGE = """Options:
-r,  --repos <DIR>...   repositories to query, the current folder by default
-d,  --data <DIR>       folder of Parquet tables to query instead
-s,  --script <FILE>    file with one or more statements
-q,  --query <TEXT>     statements
-p,  --pagination       print results in pages
-ps, --pagesize <N>     rows on a page, 10 by default
-o,  --output <FORMAT>  table (or render), csv, json, yaml
-a,  --analysis         print times
-h,  --help             print this
-v,  --version          print the version"""


@dataclass
class Arguments:
    repos: list[str] = field(default_factory=list)
    data: str | None = None
    pagination: bool = False
    page_size: int = 10
    output: str = "table"
    analysis: bool = False


def parse(argv: list[str]) -> tuple[str, object, Arguments]:
    """(mode, its text, arguments); mode is help, version, error, query, script or repl."""
    args = Arguments()
    if any(a in ("--help", "-h") for a in argv):
        return "help", None, args
    if any(a in ("--version", "-v") for a in argv):
        return "version", None, args
    query = script = None
    k = 0

    def value(what: str) -> str | None:
        return argv[k + 1] if k + 1 < len(argv) else None

    while k < len(argv):
        a = argv[k]
        if not a.startswith("-"):
            return "error", f"Unknown argument {a}", args
        if a in ("--repos", "-r"):
            if value(a) is None:
                return "error", f"Argument {a} must be followed by one or more paths", args
            while k + 1 < len(argv) and not argv[k + 1].startswith("-"):
                args.repos.append(argv[k + 1])
                k += 1
        elif a in ("--query", "-q", "--script", "-s", "--data", "-d", "--output", "-o", "--pagesize", "-ps"):
            v = value(a)
            if v is None:
                return "error", f"Argument {a} must be followed by a value", args
            k += 1
            if a in ("--query", "-q"):
                query = v
            elif a in ("--script", "-s"):
                script = v
            elif a in ("--data", "-d"):
                args.data = v
            elif a in ("--output", "-o"):
                form = {"render": "table"}.get(v.lower(), v.lower())
                if form not in ("table", "csv", "json", "yaml"):
                    return "error", "Invalid output format", args
                args.output = form
            else:
                if not v.isdigit():
                    return "error", "Invalid page size", args
                args.page_size = int(v)
        elif a in ("--pagination", "-p"):
            args.pagination = True
        elif a in ("--analysis", "-a"):
            args.analysis = True
        else:
            return "error", f"Unknown command {a}", args
        k += 1
    if not args.repos and not args.data:
        args.repos = [os.getcwd()]
    if script is not None:
        return "script", script, args
    return ("query", query, args) if query is not None else ("repl", None, args)


def show(result, args: Arguments, ask=input) -> None:
    from plinth.sources import sinks

    if result.df is None:
        return
    if args.output != "table":
        print({"csv": sinks.csv_text, "json": sinks.json_text, "yaml": sinks.yaml_text}[args.output](result.df, result.types))
        return
    if not args.pagination:
        print(sinks.table_text(result.df, result.types))
        return
    total = result.df.count()
    pages = max(1, -(-total // max(1, args.page_size)))
    page = 1
    while True:
        print(f"Page {page}/{pages}")
        print(sinks.table_text(result.df, result.types, max(1, args.page_size), page))
        if pages == 1:
            return
        answer = ask("n = next, p = previous, q = quit: ").strip().lower()
        if answer == "q":
            return
        page = min(pages, page + 1) if answer == "n" else max(1, page - 1) if answer == "p" else page


def main(argv: list[str] | None = None) -> int:
    mode, text, args = parse(sys.argv[1:] if argv is None else argv)
    if mode == "help":
        print(USAGE)
        return 0
    if mode == "version":
        import plinth

        print(plinth.__version__)
        return 0
    if mode == "error":
        print(text, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from plinth.dialect.diagnostics import Diagnostic
    from plinth.session import Session
    from plinth.sources import git

    spark = SparkSession.builder.appName("plinth").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(spark)
    try:
        if args.data:
            session.register_parquet(args.data, *sorted(n[: -len(".parquet")] for n in os.listdir(args.data) if n.endswith(".parquet")))
        else:
            git.register(session, args.repos)
    except (git.NotARepository, OSError) as x:
        print(x, file=sys.stderr)
        return 1
    if mode == "script":
        with open(text, encoding="utf-8") as f:
            text = f.read()

    def run(statement: str) -> int:
        began = time.time()
        try:
            for r in session.sql(statement):
                show(r, args)
        except Diagnostic as x:
            print(x, file=sys.stderr)
            return 1
        except Exception as x:  # noqa: BLE001 - whatever the engine reports ends the statement, not the prompt
            print(str(x).split("\n")[0], file=sys.stderr)
            return 1
        if args.analysis:
            print(f"{time.time() - began:.3f} s")
        return 0

    if mode != "repl":
        return run(text)
    while True:
        try:
            line = input("plinth > ").strip()
        except EOFError:
            return 0
        if line in ("exit", "quit"):
            return 0
        if line:
            run(line)


if __name__ == "__main__":
    sys.exit(main())
