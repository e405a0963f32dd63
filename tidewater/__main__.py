"""Command line: ``python -m tidewater --data FOLDER [--format table|csv|json] "SQL"``."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from tidewater.engine import Engine
from tidewater.errors import EngineError
from tidewater.session import create


def write(rows: list, names: list[str], style: str, out) -> None:
    if style == "csv":
        table = csv.writer(out)
        table.writerow(names)
        table.writerows([["" if v is None else v for v in r] for r in rows])
    elif style == "json":
        for r in rows:
            out.write(json.dumps(dict(zip(names, r, strict=True)), default=str) + "\n")
    else:
        cells = [names] + [["NULL" if v is None else str(v) for v in r] for r in rows]
        widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
        for k, line in enumerate(cells):
            out.write(" | ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() + "\n")
            if k == 0:
                out.write("-+-".join("-" * w for w in widths) + "\n")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewater")
    p.add_argument("--data", help="folder of <table>.parquet files")
    p.add_argument("--home", help="folder for datasets and views")
    p.add_argument("--format", choices=["table", "csv", "json"], default="table")
    p.add_argument("sql", nargs="*", help="statements; read from standard input, separated by ;, when none are given")
    a = p.parse_args(argv)
    engine = Engine(create(), a.home)
    if a.data:
        engine.catalog.add("data", "parquet", {"path": a.data})
    for text in a.sql or [s for s in sys.stdin.read().split(";\n") if s.strip()]:
        try:
            df = engine.sql(text)
            write([tuple(r) for r in df.toLocalIterator()], df.columns, a.format, sys.stdout)
        except EngineError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
