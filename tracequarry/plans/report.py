"""Runs scenarios side by side on one session and renders results: Markdown, tables, CSV, JSON."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Row

from .scenarios import SCENARIOS, Scenario, Tables
from .statements import Catalog, pack, statements  # noqa: F401  (statements is used from here)

#: Rows of a scenario that a report shows.
SHOWN = 20


@dataclass
class Result:
    """What a scenario gave: the rows that a report shows, how many there are in all, or why it failed."""

    scenario: Scenario
    columns: list[str] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)
    total: int = 0
    error: str = ""


def run_scenario(scenario: Scenario, tables: Tables) -> Result:
    """Runs one scenario; only the rows that are shown come to the driver, and an error, whatever it is, stays its own."""
    try:
        frame = scenario.plan(tables)
        rows = frame.limit(SHOWN + 1).collect()
        return Result(scenario, frame.columns, rows[:SHOWN], len(rows) if len(rows) <= SHOWN else frame.count())
    except Exception as e:
        return Result(scenario, error=f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}")


def run_pack(tables: Tables, numbers: Iterable[int] = tuple(range(1, 31)), jobs: int = 4) -> list[Result]:
    """Results in the order of the numbers; scenarios run as jobs of one session, so tables that are cached are shared."""
    with ThreadPoolExecutor(max(1, jobs)) as pool:
        return list(pool.map(lambda n: run_scenario(SCENARIOS[n], tables), sorted(numbers)))


def run_pack_text(tables: Tables, text: str, jobs: int = 4) -> list[Result]:
    """Results of the blocks of a pack of SQL, in their order; a block's error stays its own."""
    catalog = Catalog(tables)
    with ThreadPoolExecutor(max(1, jobs)) as pool:
        return list(pool.map(lambda s: run_scenario(s, catalog), pack(text)))


def _cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|")


def markdown(results: list[Result], trace: str, at: datetime | None = None) -> str:
    """A report with a table for each scenario, and how many rows it found and doesn't show; at: its date, else now."""
    failed = sum(bool(r.error) for r in results)
    date = f"{at or datetime.now():%Y-%m-%d %H:%M:%S}"
    lines = ["# Trace analysis", "", f"- Trace: {trace}", f"- Date: {date}", f"- Scenarios: {len(results)}", f"- Succeeded: {len(results) - failed}", f"- Failed: {failed}", ""]
    for r in results:
        lines += [f"## {r.scenario.number}. {r.scenario.title}", "", f"{r.scenario.goal}", ""]
        if r.error:
            lines += [f"Error: {r.error}", ""]
        elif not r.rows:
            lines += ["No data.", ""]
        else:
            lines += [f"Found {r.total} rows.", "", f"| {' | '.join(r.columns)} |", f"|{'---|' * len(r.columns)}", *(f"| {' | '.join(map(_cell, row))} |" for row in r.rows), ""]
            lines += [f"{r.total - len(r.rows)} more rows are not shown.", ""] if r.total > len(r.rows) else []
    return "\n".join(lines)


def _rows(frame: DataFrame, n: int | None) -> tuple[Iterator[Row], int]:
    """The rows, or the first n, a partition at a time; and how many that leaves out."""
    if n is None:
        return frame.toLocalIterator(), 0
    return iter(frame.limit(n).collect()), max(0, frame.count() - n)


def as_table(frame: DataFrame, n: int | None = None) -> str:
    """All rows, or the first n, in columns as wide as their values; then how many there are, and how many are left out."""
    found, more = _rows(frame, n)
    rows = [tuple("NULL" if v is None else str(v) for v in r) for r in found]
    widths = [max(map(len, column)) for column in zip(frame.columns, *rows, strict=True)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in (frame.columns, ["-" * w for w in widths], *rows)]
    return "\n".join([*lines, *[f"{more} more rows are not shown."] * bool(more), f"Total rows: {len(rows) + more}"])


def as_csv(frame: DataFrame, n: int | None = None) -> str:
    """All rows, or the first n, as CSV, quoted where needed; null is empty. Results beyond a driver: frame.write.csv."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(frame.columns)
    writer.writerows(_rows(frame, n)[0])
    return out.getvalue()


def as_json(frame: DataFrame, n: int | None = None) -> str:
    """All rows, or the first n, as a JSON list. Results beyond a driver: frame.write.json."""
    return json.dumps([r.asDict(recursive=True) for r in _rows(frame, n)[0]], indent=2, default=str, ensure_ascii=False)


def register(tables: Tables) -> None:
    """Makes all tables temporary views, for SQL of one's own by spark.sql(); a Catalog makes only those that are named."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def run_statements(tables: Tables, text: str) -> list[DataFrame]:
    """A frame for each statement of an SQL text; only tables that a statement names are made."""
    return Catalog(tables).run(text)
