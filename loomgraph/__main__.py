"""Command line: ``python -m loomgraph index PATH | status [PATH] | stats [--days N] [--reset]``."""

from __future__ import annotations

import argparse

from loomgraph.plans.engine import Engine
from loomgraph.session import build_session

ERROR_LINES = 10


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="index source trees")
    index.add_argument("paths", nargs="+")
    index.add_argument("--full", action="store_true", help="ignore the stored state")
    index.add_argument("--language", action="append")
    status = commands.add_parser("status", help="what is indexed")
    status.add_argument("path", nargs="?")
    stats = commands.add_parser("stats", help="token usage")
    stats.add_argument("--days", type=int, default=7)
    stats.add_argument("--reset", action="store_true")
    args = parser.parse_args(argv)

    engine = Engine(build_session())
    if args.command == "index":
        report = engine.index_repository(args.paths, not args.full, args.language)
        for row in report.collect():  # one row per named repository
            print({k: v for k, v in row.asDict().items() if k != "errors"})
            for line in row.errors[:ERROR_LINES]:
                print("  error:", line)
    elif args.command == "status":
        engine.index_status(args.path).show(truncate=False)
    elif args.reset:
        engine.usage_reset()
        print("usage cleared")
    else:
        engine.usage_stats(args.days).show(truncate=False)
        engine.usage_daily(args.days).show(truncate=False)


if __name__ == "__main__":
    main()
