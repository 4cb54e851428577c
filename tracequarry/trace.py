"""A trace file as an object: what is in it, chained filters on its events, and analyses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.text import process_type
from .operators import analyzer, derive
from .plans.report import as_csv, as_json, as_table
from .sources.ftrace import parse_events, read_lines, within, write_events
from .sources.index import Index

NS = 10**9
#: First lines from whose length the number of all lines is estimated, bytes of a file's head and tail that are looked at, and
#: other names of fields of events.
SAMPLED, GLANCED = 1000, 1 << 16
#: Bins that come to the driver as lists.
BINS = 1_000_000
FIELDS = {"timestamp": "ts", "time": "ts", "comm": "task", "event_type": "event"}


class TraceFile:
    """Events of a trace text or of stored events; nothing is read until an answer is asked for."""

    def __init__(self, spark: SparkSession, path: str, index: str | None = None):
        """index: a folder of events stored by build_index(); it is used if it holds the text's files as they are now."""
        self.spark, self.path, self.index = spark, path, index

    def has_index(self) -> bool:
        """Whether stored events are there, of the same files as the trace has now, each of the same length and time."""
        if self.index is None:
            return False
        stored = Index(self.spark, self.index)
        known = stored.files()
        return known is not None and known == stored.listed(self.path)

    def build_index(self, force: bool = False) -> int:
        """Stores the events of files that aren't stored yet, all of them if one has changed; returns how many were read."""
        if self.index is None:
            raise ValueError("no folder for the index was given")
        read = Index(self.spark, self.index).update(self.path, lambda files: parse_events(read_lines(self.spark, files)), write_events, force)
        for made in ("events", "tables"):
            self.__dict__.pop(made, None)
        return read

    @cached_property
    def events(self) -> DataFrame:
        """All events; stored ones have their partition of time, ts_part, too."""
        return Index(self.spark, self.index).events() if self.has_index() else parse_events(read_lines(self.spark, self.path))

    @cached_property
    def tables(self) -> derive.Tables:
        """The relational tables of the trace."""
        return derive.trace_tables(self.events)

    def processes(self) -> DataFrame:
        """pid, comm and type of each thread; pid 0 once for each CPU."""
        return self.tables["thread"].select(F.col("tid").alias("pid"), F.col("name").alias("comm"), process_type("name", "tid").alias("type"))

    def get_processes(self) -> list[Row]:
        """processes() as a list, by pid."""
        return self.processes().orderBy("pid", "comm").collect()

    def file_info(self) -> dict[str, Any]:
        """filepath, file_size (as text), line_count (estimated from the length of the first lines) and indexed."""
        size = sum(n for n, _ in Index(self.spark, self.path).listed(self.path).values())
        first = [len(r.value.encode()) + 1 for r in self.spark.read.text(self.path).limit(SAMPLED).collect()]
        lines = len(first) if len(first) < SAMPLED else round(size * len(first) / sum(first))
        return {"filepath": self.path, "file_size": size_text(size), "line_count": lines, "indexed": self.has_index()}

    def _info(self, events: int, first: int | None, last: int | None, kinds: list, cpus: int, processes: int) -> dict[str, Any]:
        start, end = (first or 0) / NS, (last or 0) / NS
        return {"event_count": events, "time_range": {"start": start, "end": end, "duration": end - start}, "event_types": sorted(k for k in kinds if k is not None), "cpu_count": cpus, "process_count": processes}

    def info(self) -> dict[str, Any]:
        """file_info(), event_count, time_range (start, end, duration in s), event_types, cpu_count and process_count.

        With an index this reads its two side tables and no event; without one it is a pass over the text, for which
        glance() is the quick form.
        """
        if self.has_index():
            stored = Index(self.spark, self.index)
            r = stored.totals().agg(F.sum("events"), F.min("first"), F.max("last"), F.collect_set("event"), F.count_distinct("cpu")).first()
            processes = stored.pids().where("own").agg(F.count_distinct("pid")).first()[0]
        else:
            r = self.events.agg(F.count("*"), F.min("ts"), F.max("ts"), F.collect_set("event"), F.count_distinct("cpu"), F.count_distinct("pid")).first()
            processes = r[5]
        return self.file_info() | self._info(r[0] or 0, r[1], r[2], r[3], r[4], processes)

    def glance(self) -> dict[str, Any]:
        """info() from the first and last bytes of each file, whatever their length: event_count is estimated from the
        length of those lines, and types, CPUs and processes are those seen there."""
        stored = Index(self.spark, self.path)
        files, texts = stored.listed(self.path), []
        for name, (length, _) in files.items():
            head = stored.part(name, 0, GLANCED)
            tail = stored.part(name, max(GLANCED, length - GLANCED), GLANCED) if length > GLANCED else b""
            # the lines at the cut are not whole
            texts += (head if length <= GLANCED else head[: head.rfind(b"\n") + 1]).decode(errors="replace").split("\n")
            texts += tail[tail.find(b"\n") + 1 if length > 2 * GLANCED else 0 :].decode(errors="replace").split("\n")
        lines = [(x, k) for k, x in enumerate(texts) if x]
        seen = parse_events(self.spark.createDataFrame(lines, "value string, place long"))
        r = seen.agg(F.count("*"), F.min("ts"), F.max("ts"), F.collect_set("event"), F.count_distinct("cpu"), F.count_distinct("pid")).first()
        size, looked = sum(n for n, _ in files.values()), sum(len(x.encode()) + 1 for x, _ in lines)
        grown = max(1.0, size / looked) if looked else 1.0
        return {"filepath": self.path, "file_size": size_text(size), "line_count": round(len(lines) * grown), "indexed": self.has_index()} | self._info(round(r[0] * grown), r[1], r[2], r[3], r[4], r[5])

    def summary(self) -> str:
        """info() as text."""
        return "\n".join(f"{k}: {v}" for k, v in self.info().items())

    def get_time_range(self) -> tuple[float, float]:
        """First and last time in seconds; zeros for an empty trace."""
        first, last = self.events.agg(F.min("ts"), F.max("ts")).first()
        return (first or 0) / NS, (last or 0) / NS

    def get_duration(self) -> float:
        """Seconds from the first to the last event."""
        first, last = self.get_time_range()
        return last - first

    def get_event_count(self) -> int:
        """Events, exactly."""
        return self.events.count()

    def get_cpus(self) -> list[int]:
        """Numbers of the CPUs."""
        return sorted(r[0] for r in self.events.select("cpu").distinct().collect())

    def get_process_types(self) -> dict[str, list[Row]]:
        """Threads by type, all five always, as a report lists them; process_types() is the same as a frame."""
        found: dict[str, list[Row]] = {k: [] for k in analyzer.CONTEXTS}
        for row in self.processes().orderBy("pid", "comm").toLocalIterator():
            found[row["type"]].append(row)
        return found

    def process_types(self) -> DataFrame:
        """type, threads and names (distinct) of the types that occur."""
        return self.processes().groupBy("type").agg(F.count("*").alias("threads"), F.count_distinct("comm").alias("names"))

    def query(self) -> QueryBuilder:
        """A query over all events; by pid it reads only the partitions of an index in which the pid occurs."""
        return QueryBuilder(self.events, parts=Index(self.spark, self.index).parts_of if self.has_index() else None)


def size_text(size: float) -> str:
    """Bytes as a short text."""
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"


class QueryBuilder:
    """Filters that add up (and); each call returns a new query.

    ordered: the order is one that was asked for; parts: says in which partitions of time (ts_part) pids occur.
    """

    def __init__(self, frame: DataFrame, ordered: bool = False, parts: Callable[[tuple[int, ...]], list[int] | None] | None = None):
        self.frame, self.ordered, self.parts = frame, ordered, parts

    def _with(self, frame: DataFrame) -> QueryBuilder:
        return QueryBuilder(frame, self.ordered, self.parts)

    def where(self, condition: Column) -> QueryBuilder:
        return self._with(self.frame.where(condition))

    def time_range(self, start: float, end: float) -> QueryBuilder:
        """Events from start to end, both included, in seconds; stored events outside are not read."""
        return self._with(within(self.frame, round(start * NS), round(end * NS)))

    def time_slice(self, duration: float, offset: float = 0.0) -> QueryBuilder:
        """Events from offset on for a duration, in seconds from the trace's first event."""
        first = self.frame.agg(F.min("ts")).first()[0]
        start = (first or 0) + round(offset * NS)
        return self._with(within(self.frame, start, start + round(duration * NS)))

    def around_time(self, time: float, window: float = 0.1) -> QueryBuilder:
        """Events up to window seconds before and after a time."""
        return self.time_range(time - window, time + window)

    def cpu(self, *cpus: int) -> QueryBuilder:
        return self.where(F.col("cpu").isin(*cpus))

    def pid(self, *pids: int) -> QueryBuilder:
        """Events of these pids; a switch belongs to both its sides, or where one isn't said to the thread that it names."""
        switch, own = F.col("event") == "sched_switch", F.col("pid").isin(*pids)
        sides = switch & (F.col("prev_pid").isin(*pids) | F.col("next_pid").isin(*pids))
        other = own & (F.col("event").isNull() | (F.col("event") != "sched_switch") | F.col("prev_pid").isNull() | F.col("next_pid").isNull())
        parts = self.parts(pids) if self.parts else None
        return self.where(sides | other if parts is None else F.col("ts_part").isin(parts) & (sides | other))

    def comm(self, *names: str, pattern: str | None = None) -> QueryBuilder:
        """Events of threads with one of these names, or a name that holds a pattern."""
        found = F.lit(False)
        for column in ("task", "prev_comm", "next_comm"):
            found = found | F.col(column).isin(*names) if names else found
            found = found if pattern is None else found | F.col(column).rlike(pattern)
        return self.where(found)

    def process_type(self, *types: str) -> QueryBuilder:
        return self.where(process_type("task", "pid").isin(*types))

    def prev_state(self, *states: str) -> QueryBuilder:
        return self.where(F.col("prev_state").isin(*states))

    def event_type(self, *types: str) -> QueryBuilder:
        return self.where(F.col("event").isin(*types))

    def _column(self, field: str) -> str:
        """The column of a field, by its own name or the one that the events of other tools have."""
        return field if field in self.frame.columns else FIELDS.get(field, field)

    def group_by(self, *fields: str) -> QueryBuilder:
        """Counts by fields; comm is the task that the line names."""
        return QueryBuilder(self.frame.groupBy(*[F.col(self._column(f)).alias(f) for f in fields]).agg(F.count("*").alias("count")))

    def order_by(self, field: str, ascending: bool = True) -> QueryBuilder:
        ties = [c for c in ("place",) if c in self.frame.columns]
        column = F.col(self._column(field))
        return QueryBuilder(self.frame.orderBy(column.asc() if ascending else column.desc(), *ties), True)

    def limit(self, n: int) -> QueryBuilder:
        """The first n rows: in the order that was asked for, else in that of time."""
        return QueryBuilder(self.execute().sorted().limit(n), True)

    def execute(self) -> QueryResult:
        return QueryResult(self.frame, self.ordered)

    def count(self) -> int:
        return self.frame.count()

    def first(self, n: int = 1) -> list[Row]:
        """The first n rows, in the order that was asked for, else in that of time."""
        return self.execute().sorted().limit(n).collect()

    def to_dataframe(self):
        """The rows as a pandas frame; for results that fit the driver."""
        return self.execute().to_dataframe()


class QueryResult:
    """Rows of a query, still a plan: frame. ordered: they have an order that was asked for."""

    def __init__(self, frame: DataFrame, ordered: bool = False):
        self.frame, self.ordered = frame, ordered

    def sorted(self) -> DataFrame:
        """The rows in the order that was asked for, else by time, else (grouped ones) by their columns."""
        if self.ordered:
            return self.frame
        return self.frame.orderBy(*(["ts", "place"] if {"ts", "place"} <= set(self.frame.columns) else self.frame.columns))

    def shown(self) -> DataFrame:
        """sorted() without the columns that only tell where rows lie."""
        return self.sorted().drop("place", "ts_part")

    @property
    def events(self) -> Iterator[Row]:
        return iter(self)

    def __len__(self) -> int:
        return self.frame.count()

    def __iter__(self) -> Iterator[Row]:
        return self.sorted().toLocalIterator()

    def __getitem__(self, n: int) -> Row:
        found = self.sorted().offset(n).limit(1).collect() if n >= 0 else self.sorted().tail(-n)[: len(self) + n >= 0]
        if not found:
            raise IndexError(n)
        return found[0]

    def filter(self, condition: Column | Callable[[Row], bool]) -> QueryResult:
        """Rows that meet a column condition, or a Python one (slow: each row goes to Python)."""
        if isinstance(condition, Column):
            return QueryResult(self.frame.where(condition), self.ordered)
        keep = F.udf(lambda row: bool(condition(row)), "boolean")
        return QueryResult(self.frame.where(keep(F.struct(*self.frame.columns))), self.ordered)

    def by(self, *fields: str) -> DataFrame:
        """Count, first and last time of each value of the fields (cpu, pid, prev_state)."""
        return self.frame.groupBy(*fields).agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def groups(self, field: str) -> Groups:
        """Results by the value of a field."""
        return Groups(self, field)

    def by_cpu(self) -> Groups:
        return self.groups("cpu")

    def by_process(self) -> Groups:
        return self.groups("pid")

    def by_state(self) -> Groups:
        return self.groups("prev_state")

    def timeline(self, bin_size: float = 0.001) -> DataFrame:
        """bin, bin_start and count of each bin of bin_size seconds from the first event to the last, empty ones too."""
        width, spark = round(bin_size * NS), self.frame.sparkSession
        t0, t1 = self.frame.agg(F.min("ts"), F.max("ts")).first()
        n = 0 if t0 is None else (t1 - t0) // width + 1
        counts = self.frame.groupBy(F.expr(f"(ts - {t0 or 0}) div {width}").alias("bin")).agg(F.count("*").alias("n"))
        bins = spark.range(0, n).toDF("bin")  # in as many partitions as there are cores, whatever the number of bins
        return bins.join(counts, "bin", "left").select("bin", (F.lit(t0 or 0) + F.col("bin") * width).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("count"))

    def summary(self) -> dict[str, Any]:
        """count, time_range, cpus, processes and state_distribution."""
        found = self.frame.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.array_sort(F.collect_set("cpu")).alias("cpus"), F.count_distinct("pid").alias("processes")).first()
        states = {r["prev_state"]: r["count"] for r in self.frame.where("prev_state IS NOT NULL").groupBy("prev_state").count().collect()}
        return {"count": found["n"], "time_range": ((found["a"] or 0) / NS, (found["b"] or 0) / NS), "cpus": found["cpus"], "processes": found["processes"], "state_distribution": states}

    def describe(self) -> str:
        """summary() as text."""
        return "\n".join(f"{k}: {v}" for k, v in self.summary().items())

    def to_text(self, kind: str = "table", n: int | None = None) -> str:
        """All rows, or the first n, as a table, a list of fields, or the raw messages."""
        if kind == "table":
            return as_table(self.shown(), n)
        rows = self.lines(kind)
        return "\n".join(r["line"] for r in (rows if n is None else rows.limit(n)).toLocalIterator())

    def lines(self, kind: str = "raw") -> DataFrame:
        """The rows in order as text lines (line): the raw messages, or lists of fields; to_text() of any size."""
        if kind == "raw":
            return self.sorted().select(F.col("message").alias("line"))
        shown = self.shown()
        said = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in shown.columns]
        return shown.select(F.concat_ws(", ", *said).alias("line"))

    def to_json(self, n: int | None = None) -> str:
        return as_json(self.shown(), n)

    def to_csv(self, path: str | None = None, n: int | None = None) -> str | None:
        """Writes all rows as CSV to a folder, or returns them, or the first n."""
        if path is None:
            return as_csv(self.shown(), n)
        self.shown().write.mode("overwrite").csv(path, header=True)
        return None

    def to_dataframe(self):
        """The rows as a pandas frame; for results that fit the driver."""
        return self.shown().toPandas()


class Groups(Mapping[Any, QueryResult]):
    """The values of a field, each with the result of its rows; only the distinct values come to the driver, when asked for.

    A null value is a key. A result's rows are read by a filter on its value when they are asked for.
    """

    def __init__(self, result: QueryResult, field: str):
        self.result, self.field = result, field

    @cached_property
    def values_found(self) -> list[Any]:
        return [r[0] for r in self.result.frame.select(self.field).distinct().orderBy(self.field).toLocalIterator()]

    def __getitem__(self, key: Any) -> QueryResult:
        if key not in self.values_found:
            raise KeyError(key)
        same = F.col(self.field).isNull() if key is None else F.col(self.field) == key
        return QueryResult(self.result.frame.where(same), self.result.ordered)

    def __iter__(self) -> Iterator[Any]:
        return iter(self.values_found)

    def __len__(self) -> int:
        return len(self.values_found)

    def table(self) -> DataFrame:
        """Count, first and last time of each value."""
        return self.result.by(self.field)

    def write(self, path: str) -> None:
        """Writes the rows as Parquet in a folder for each value, within it in order over the parts; no group is one task."""
        order = [c for c in ("ts", "place") if c in self.result.frame.columns]
        self.result.frame.repartitionByRange(self.field, *order).sortWithinPartitions(self.field, *order).write.mode("overwrite").partitionBy(self.field).parquet(path)


def _first(frame: DataFrame, n: int | None) -> Iterator[Row]:
    """All rows, a partition at a time, or the first n."""
    return (frame if n is None else frame.limit(n)).toLocalIterator()


class Analyzer:
    """Analyses of a trace file with plain results; the frames behind them are in operators.analyzer."""

    def __init__(self, trace: TraceFile):
        self.trace = trace

    def detect_time_anomalies(self, threshold_us: float = 100, by: str | None = None, n: int | None = None) -> dict[str, Any]:
        """Gaps of all events above a threshold, the longest first (n: only so many), and their summary."""
        gaps = analyzer.time_gaps(self.trace.events, round(threshold_us * 1000), by)
        total = analyzer.time_gap_summary(gaps).first()
        us = lambda v: None if v is None else v / 1000
        return {
            "gaps": [{"start": r["gap_start"] / NS, "end": r["gap_end"] / NS, "duration_us": us(r["gap_ns"]), "prev_event": r["prev_event"], "next_event": r["next_event"]} for r in _first(gaps.orderBy(F.desc("gap_ns"), "gap_start"), n)],
            "summary": {"total_gaps": total["total_gaps"], "max_gap_us": us(total["max_gap_ns"]), "p95_gap_us": us(total["p95_gap_ns"])},
        }

    def get_time_distribution(self, bin_size: float = 0.001) -> dict[str, Any]:
        """Bins with events or load, and stretches of high load, as lists; analyzer.time_distribution() is the frame.

        More than BINS bins are an error: take wider ones, or the frame.
        """
        width, t = round(bin_size * NS), self.trace.tables
        found = analyzer.time_distribution(t["sched"], t["thread"], width)
        rows = [(r["bin_start"] / NS, r["event_count"], r["cpu_util"]) for r in found.orderBy("bin").limit(BINS + 1).collect()]
        if len(rows) > BINS:
            raise ValueError(f"more than {BINS} bins of {bin_size} s")
        hot = analyzer.hotspots(found, width).orderBy("start").toLocalIterator()
        return {"bins": [r[0] for r in rows], "event_counts": [r[1] for r in rows], "cpu_util": [r[2] for r in rows], "hotspots": [{"start": r["start"] / NS, "end": r["end"] / NS, "util": r["util"]} for r in hot]}

    def classify_contexts(self) -> dict[str, dict[str, Any]]:
        """Share of CPU time of each context, and the distinct thread names of user processes and kernel threads."""
        t = self.trace.tables
        names: dict[str, list[str]] = {}
        for r in self.trace.processes().where("type IN ('user', 'kernel_thread')").select("type", "comm").distinct().orderBy("comm").toLocalIterator():
            names.setdefault(analyzer.CONTEXTS[r["type"]], []).append(r["comm"])
        found = {r["context"]: {"count": r["count"], "time_percent": r["time_percent"]} for r in analyzer.contexts(t["sched"], t["thread"]).collect()}
        found["user_process"]["processes"] = names.get("user_process", [])
        found["kernel_thread"]["threads"] = names.get("kernel_thread", [])
        return found

    def get_context_timeline(self, cpu: int, n: int | None = None) -> list[dict[str, Any]]:
        """The runs of a CPU in the order of time, or the first n."""
        t = self.trace.tables
        return [r.asDict() for r in _first(analyzer.context_timeline(t["sched"], t["thread"], cpu).orderBy("start"), n)]

    def _thread(self, who: int | str) -> int:
        """The pid of a thread by its name; of several the least. A pid stays."""
        if isinstance(who, int):
            return who
        found = self.trace.processes().where(F.col("comm") == who).agg(F.min("pid")).first()[0]
        return -1 if found is None else found

    def check_process_running(self, pid: int | str, time_range: tuple[float, float] | None = None, gap_ms: float = 5000.0, n: int | None = None) -> dict[str, Any]:
        """Whether and how long a pid, or the thread of a name, ran, and its times off the CPU above gap_ms (or the first n)."""
        t, pid = self.trace.tables, self._thread(pid)
        start, end = (round(x * NS) for x in time_range) if time_range else (None, None)
        r = analyzer.thread_running(t["sched"], t["thread"], pid, start, end).first()
        gaps = _first(analyzer.thread_gaps(t["sched"], t["thread"], pid, round(gap_ms * 1e6)).orderBy("gap_start"), n)
        return {"is_running": r["is_running"], "run_time": r["run_time_ns"] / NS, "run_percent": r["run_percent"], "sched_count": r["sched_count"], "avg_timeslice_ms": r["avg_timeslice_ns"] / 1e6, "gaps": [(g["gap_start"] / NS, g["gap_end"] / NS) for g in gaps]}

    def compare_cpu_time(self, *pids: int) -> dict[int, dict[str, float]]:
        t = self.trace.tables
        return {r["pid"]: {"time": r["time_ns"] / NS, "percent": r["percent"]} for r in analyzer.cpu_time(t["sched"], t["thread"], list(pids)).collect()}

    def detect_time_gaps(self, pid: int | None = None, threshold_ms: float = 1.0, n: int | None = None) -> list[dict[str, Any]]:
        """Times off the CPU, the longest first, and what the CPU did meanwhile: its main context and how many runs.

        last_seen and next_seen say when, on which CPU and (last) in which state the thread left and came back.

        For one pid also the names of the processes that ran; for all of them together that list would be every thread's
        for nearly every gap.
        """
        t = self.trace.tables
        gaps = analyzer.thread_gaps(t["sched"], t["thread"], pid, round(threshold_ms * 1e6))
        found = analyzer.gap_activity(gaps, t["sched"], t["thread"])
        if pid is not None:
            found = found.join(analyzer.gap_processes(gaps, t["sched"], t["thread"]), ["gap_start", "gap_end", "cpu"], "left")
        names = lambda r: {} if pid is None else {"processes": r["processes"] or []}
        rows = _first(found.orderBy(F.desc("duration_ns"), "gap_start", "utid"), n)
        return [{"pid": r["pid"], "comm": r["comm"], "gap_start": r["gap_start"] / NS, "gap_end": r["gap_end"] / NS, "duration_ms": r["duration_ns"] / 1e6, "last_seen": {"ts": r["gap_start"] / NS, "cpu": r["cpu"], "state": r["end_state"]}, "next_seen": {"ts": r["gap_end"] / NS, "cpu": r["next_cpu"]}, "cpu_activity": {"dominant_context": r["dominant_context"], "runs": r["runs"]} | names(r)} for r in rows]

    def detect_qos_patterns(self) -> dict[str, Any]:
        """CPUs whose gaps look like throttling by a quota."""
        rows = analyzer.qos_gaps(self.trace.events).collect()
        details = {f"cpu_{r['cpu']}": {"confidence": r["confidence"], "gaps": r["gaps"], "avg_duration_ms": r["avg_ns"] / 1e6} for r in rows}
        return {"suspected_qos": any(d["confidence"] == "high" for d in details.values()), "details": details}
