"""python -m pathquery: search a saved catalogue, show its state, or watch a query's hits as the catalogue changes."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from . import PathQueryError
from .api import Engine
from .operators import build


def table(rows: list[dict]) -> str:
    """Rows as columns of text, as wide as what is in them."""
    cells = [list(rows[0]), *([str(v) for v in r.values()] for r in rows)] if rows else []
    wide = [max(len(c[i]) for c in cells) for i in range(len(cells[0]))] if cells else []
    return "\n".join("  ".join(x.ljust(n) for x, n in zip(c, wide)).rstrip() for c in cells)


def shown(rows: list[dict], as_json: bool) -> str:
    return json.dumps(rows, ensure_ascii=False) if as_json else table(rows)


def page(engine: Engine, a: argparse.Namespace) -> list[dict]:
    return [r.asDict(True) for r in engine.search(a.query, a.limit, a.offset, a.pinyin).select("name", "path", "size", "mtime").collect()]  # a page


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout, rounds: int | None = None) -> int:
    p = argparse.ArgumentParser(prog="pathquery", description=__doc__)
    p.add_argument("catalogue", help="folder that build.save() or Catalogue.refresh() wrote")
    p.add_argument("command", choices=["search", "count", "status", "watch"])
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--json", action="store_true")
    p.add_argument("--pinyin", action="store_true", help="find Chinese names by romanised spelling")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--interval", type=float, default=2.0, help="seconds between looks, for watch")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("pathquery").getOrCreate()
    try:
        if a.command == "watch":
            seen = None
            while rounds is None or rounds > 0:
                now = build.versions(spark, a.catalogue)[-1:]
                if now != seen:
                    seen = now
                    print(shown(page(Engine.load(spark, a.catalogue), a), a.json), file=out, flush=True)
                rounds = None if rounds is None else rounds - 1
                time.sleep(a.interval if rounds != 0 else 0)
            return 0
        engine = Engine.load(spark, a.catalogue)
        if a.command == "search":
            print(shown(page(engine, a), a.json), file=out)
        elif a.command == "count":
            print(engine.count(a.query, a.pinyin), file=out)
        else:
            print(shown([engine.status()], a.json), file=out)
        return 0
    except PathQueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
