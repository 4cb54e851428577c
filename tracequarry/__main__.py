"""python -m tracequarry TRACE with what to show; every answer comes from the trace object or a scenario."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .functions.progress import Progress
from .plans.report import as_csv, as_json, as_table, markdown, run_pack, run_pack_text, run_statements
from .plans.scenarios import SCENARIOS
from .sources.ftrace import BASE, read_lines, write_kernel_log
from .trace import Analyzer, TraceFile


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracequarry", description="Questions on a kernel trace text.")
    parser.add_argument("trace")
    parser.add_argument("--index", help="folder of stored events; it is made if it isn't there")
    parser.add_argument("--summary", action="store_true")
    parser.add_argument("--info", action="store_true")
    parser.add_argument("--classify", action="store_true", help="share of CPU time by context")
    parser.add_argument("--analyze-gaps", type=float, metavar="MS", help="times off the CPU above so many milliseconds")
    parser.add_argument("--stats", metavar="NAME", help="CPU time of a thread by its name or pid")
    parser.add_argument("--query-pid", type=int, metavar="PID")
    parser.add_argument("--query-event", metavar="EVENT")
    parser.add_argument("--time-range", type=float, nargs=2, metavar=("START", "END"))
    parser.add_argument("--export-csv", metavar="FOLDER", help="writes the events of the query instead of showing them")
    parser.add_argument("--scenario", type=int, choices=sorted(SCENARIOS), metavar="NUMBER")
    parser.add_argument("--sql", help="statements over the trace's tables, parted by semicolons")
    parser.add_argument("--sql-file", metavar="FILE", help="the same from a file")
    parser.add_argument("--sql-pack", metavar="FILE", help="titled blocks of SQL that the report runs instead of the scenarios")
    parser.add_argument("--kernel-log", metavar="PATH", help="writes the events as a kernel log: a file, or a folder of parts with --parts")
    parser.add_argument("--base-time", default=BASE, metavar="TIME", help="time to which a kernel log adds the trace's")
    parser.add_argument("--parts", action="store_true", help="a kernel log in many parts, for long traces")
    parser.add_argument("--format", choices=("table", "csv", "json"), default="table")
    parser.add_argument("--report", metavar="FILE", help="all scenarios as Markdown; a file newer than a local trace stays unless --force")
    parser.add_argument("--jobs", type=int, default=4)
    parser.add_argument("--force", action="store_true")
    return parser


def fresh(report: str, trace: str) -> bool:
    """Whether a report is there and newer than the trace, as far as both are local files."""
    return os.path.exists(report) and os.path.exists(trace) and os.path.getmtime(report) > os.path.getmtime(trace)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Shows what the flags ask for; 1 if a report's scenarios all failed."""
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tracequarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    trace = TraceFile(spark, args.trace, args.index)
    if args.index:
        trace.build_index(args.force)
    analyzer, show = Analyzer(trace), {"table": as_table, "csv": as_csv, "json": as_json}[args.format]
    if args.summary:
        print(trace.summary())
    if args.info:
        print(json.dumps(trace.info(), default=str))
    if args.classify:
        print(json.dumps(analyzer.classify_contexts(), ensure_ascii=False))
    if args.analyze_gaps is not None:
        print(json.dumps(analyzer.detect_time_gaps(args.query_pid, args.analyze_gaps), ensure_ascii=False))
    if args.stats is not None:
        print(json.dumps(analyzer.check_process_running(int(args.stats) if args.stats.isdecimal() else args.stats, args.time_range)))
    query = trace.query()
    query = query if args.query_pid is None else query.pid(args.query_pid)
    query = query if args.query_event is None else query.event_type(args.query_event)
    query = query if args.time_range is None else query.time_range(*args.time_range)
    if args.export_csv:
        query.execute().to_csv(args.export_csv)
    elif args.analyze_gaps is None and args.stats is None and (args.query_pid is not None or args.query_event or args.time_range):
        print(show(query.execute().shown()))
    if args.scenario:
        print(show(SCENARIOS[args.scenario].plan(trace.tables)))
    for text in (args.sql, args.sql_file and "\n".join(r.value for r in spark.read.text(args.sql_file, wholetext=True).collect())):
        for frame in run_statements(trace.tables, text or ""):
            print(show(frame))
    if args.kernel_log:
        told = lambda read, written, seconds: print(f"{read} lines read, {written} rows written, {seconds:.1f} s", file=sys.stderr)
        with Progress(spark, told):
            done = write_kernel_log(read_lines(spark, args.trace), args.kernel_log, args.base_time, not args.parts)
        print(f"{done['rows']} rows in {done['seconds']:.1f} s, {done['rows_per_second']:.0f} rows a second")
    if args.report and (args.force or not fresh(args.report, args.trace)):
        if args.sql_pack:
            text = "\n".join(r.value for r in spark.read.text(args.sql_pack, wholetext=True).collect())
            results = run_pack_text(trace.tables, text, args.jobs)
        else:
            results = run_pack(trace.tables, jobs=args.jobs)
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(markdown(results, args.trace))
        return int(all(r.error for r in results))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
