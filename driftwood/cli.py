"""Analyses from the command line: python -m driftwood.cli, or spark-submit with this file.

    list                                   the analyzers
    analyze --file FILE [NAME ...]         the series in the first column of a CSV file, by all analyzers or those named
    draws --file FILE [--confidence C]     the report of a draw history (csv, dat, xlsx, db, sqlite)

Results are printed as JSON lines, or written to the folder that --out names.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from driftwood.functions.analyzers import ANALYZERS, analyze_batch
from driftwood.functions.reports import draw_report
from driftwood.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="driftwood", description="Analyses of series and draw histories on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the analyzers")
    analyze = commands.add_parser("analyze", help="a series from a CSV file")
    draws = commands.add_parser("draws", help="the report of a draw history")
    analyze.add_argument("names", nargs="*", metavar="NAME", help="analyzers; all if none is named")
    draws.add_argument("--confidence", type=float, default=0.95)
    for command in (analyze, draws):
        command.add_argument("--file", required=True)
        command.add_argument("--out", help="a new folder for the results; else they are printed")
        command.add_argument("--form", choices=("json", "parquet"), default="json")
    return out


def results(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "draws":
        return draw_report(files.as_series(files.read_draws(spark, args.file)), args.confidence)
    return analyze_batch(files.read_series_csv(spark, args.file), args.names or list(ANALYZERS))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(f"{name}: {a.framework}, at least {a.least} values" for name, a in ANALYZERS.items()))
        return 0
    if unknown := [n for n in getattr(args, "names", []) if n not in ANALYZERS]:
        print(f"no such analyzer: {', '.join(unknown)}", file=sys.stderr)
        return 2
    out = results(spark or SparkSession.builder.appName("driftwood").getOrCreate(), args)
    if args.out:
        files.write_results(out, args.out, args.form)
    else:
        for line in out.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
