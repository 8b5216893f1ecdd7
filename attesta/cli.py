"""Command line: report and delta over scan files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from attesta.plans import pipeline
from attesta.plans.tables import written
from attesta.sinks import xlsx
from attesta.sources import scanset

COMMANDS = ("report", "delta")
#: Warnings that a workbook names at most; all of them are told on the way.
MOST_LISTED = 10_000
#: Options with one value, and with any number of them.
ONE, MANY = ("--output",), ("--results", "--baseline", "--current", "--benchmarks")


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attesta", description="Reports on compliance scans, and on what changed between two sets of them.")
    commands = top.add_subparsers(dest="command", required=True)
    report, delta = (commands.add_parser(c) for c in COMMANDS)
    report.add_argument("--results", nargs="+", required=True)
    delta.add_argument("--baseline", nargs="+", required=True)
    delta.add_argument("--current", nargs="+", required=True)
    for p in (report, delta):
        p.add_argument("--benchmarks", nargs="*", default=[])
        p.add_argument("--output")
        p.add_argument("--verbose", action="store_true", help="tell of each file read, and every warning")
    return top


def _late_command(argv: list[str]) -> str | None:
    """A command behind other arguments; the value of an option is none, whatever its name."""
    option = ""
    for a in argv:
        if a.startswith("-"):
            option = a
        elif option in MANY:
            continue
        elif option in ONE:
            option = ""
        elif a in COMMANDS:
            return a
    return None


def _arguments(argv: list[str]) -> list[str]:
    """Without a command, report is meant; a command after other arguments is an error."""
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        if _late_command(argv):
            print(f"the command comes first: {_late_command(argv)}", file=sys.stderr)
            raise SystemExit(2)
        return ["report", *argv]
    return argv


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(_arguments(list(sys.argv[1:] if argv is None else argv)))
    spark = spark or SparkSession.builder.appName("attesta").getOrCreate()

    def say(messages: Iterable[str]) -> None:
        for m in messages:
            print(f"warning: {m}", file=sys.stderr)

    read = (lambda done, total: print(f"read {done} of {total} files", file=sys.stderr)) if args.verbose else None
    try:
        for paths in (args.results,) if args.command == "report" else (args.baseline, args.current, args.benchmarks):
            found = scanset.resolve(spark, paths, (*scanset.RESULT_SUFFIXES, ".zip"))
            gone = scanset.missing(spark, found)
            if gone or (paths and not found):
                raise pipeline.PipelineError(f"No such file: {', '.join(gone or paths)}", [])
        if args.command == "report":
            parsed = pipeline.parse(spark, args.results, args.benchmarks, progress=read)
            say(pipeline.lines(parsed.told(args.verbose)))
            path = args.output or pipeline.report_name()
            paths, lost = xlsx.write_report_volumes(parsed.findings, path, pipeline.ORDER)
        else:
            runs = [pipeline.parse(spark, p, args.benchmarks, allow_empty=True, progress=read) for p in (args.baseline, args.current)]
            result = pipeline.compare(*runs)
            told = written(pipeline.told_of_delta(pipeline.merged_warnings(*(r.told(args.verbose) for r in runs)), result.warnings), "told")
            say(pipeline.lines(told))
            path = args.output or pipeline.report_name("delta")
            paths, lost = xlsx.write_delta_volumes(result, path, pipeline.first_lines(told, MOST_LISTED))
        say(lost)
    except (pipeline.PipelineError, ValueError, OSError, PySparkException, Py4JJavaError) as e:
        say(getattr(e, "warnings", []))
        print(f"error: {str(e).strip().partition(chr(10))[0]}", file=sys.stderr)
        return 1
    print("\n".join(paths))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
