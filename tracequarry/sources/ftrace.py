"""Kernel trace text: lines with their place, events with their fields, and the stored form that queries prune."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .index import PARTITION_NS, Index

# The forms of a trace line and of the fields of its message.
LINE = r"(?s)^\s*(.*?)-(\d+)\s+\[(\d+)\]\s+(\S{4,5})\s+([\d.]+):\s+(.*)$"
FIELDS = {
    "prev_comm": (r"prev_comm=(\S+)", "string"),
    "prev_pid": (r"prev_pid=(\d+)", "long"),
    "prev_prio": (r"prev_prio=(\d+)", "int"),
    "prev_state": (r"prev_state=([A-Z])", "string"),
    "next_comm": (r"next_comm=(\S+)", "string"),
    "next_pid": (r"next_pid=(\d+)", "long"),
    "next_prio": (r"next_prio=(\d+)", "int"),
}
WAKE_FIELDS = {"wake_comm": (r"(?:^|\s)comm=(\S+)", "string"), "wake_pid": (r"(?:^|\s)pid=(\d+)", "long")}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value and place of each line of a path or of several; place sorts as the lines stand in the files."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select("value", F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("row")).alias("place"))


def _field(pattern: str, kind: str, text: str = "message") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(kind)


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of lines(value, place): the columns of RAW_EVENT, then cpu_text (as written) and place.

    Empty lines, those that begin with # and those with 'buffer started' are skipped, as are lines of another form and
    those whose time isn't a number. One replacement takes a line apart, so the pattern runs once for all its groups.
    """
    # a line holds no line break, so that parts the pieces; the message comes last and is taken as it is
    value = F.col("value")
    usable = lines.where(~F.col("value").startswith("#") & (F.col("value") != "") & ~F.contains("value", F.lit("buffer started")))
    # as the output of a generator the parts are made once: filters on them don't move below it
    parts = usable.select("place", F.explode_outer(F.array(F.split(F.regexp_replace(value, LINE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n", 6))).alias("p")).where("size(p) = 6")
    found = parts.select(
        F.col("p")[0].alias("task"), F.col("p")[1].try_cast("long").alias("pid"), F.col("p")[2].try_cast("int").alias("cpu"), F.col("p")[2].alias("cpu_text"), F.col("p")[3].alias("flags"),
        F.col("p")[4].try_cast("decimal(20,9)").alias("ts_sec"), F.col("p")[5].alias("message"), "place",
    ).where("ts_sec IS NOT NULL")
    switch, wake = F.contains("message", F.lit("sched_switch:")), F.col("message").rlike(r"^sched_wak(eup|ing|eup_new):")
    fields = [F.when(switch, _field(p, k)).alias(n) for n, (p, k) in FIELDS.items()] + [F.when(wake, _field(p, k)).alias(n) for n, (p, k) in WAKE_FIELDS.items()]
    event = F.nullif(F.regexp_extract("message", r"^([^\s:]+):", 1), F.lit("")).alias("event")
    return found.select("task", "pid", "cpu", "flags", (F.col("ts_sec") * 1_000_000_000).cast("long").alias("ts"), "ts_sec", event, "message", *fields, "cpu_text", "place")


def parse_switches(lines: DataFrame) -> DataFrame:
    """The fields of all lines that say sched_switch:, each null where its form doesn't occur; cpu stays as text."""
    found = lines.where(F.contains("value", F.lit("sched_switch:")))
    cpu = _field(r"\[(\d+)\]", "string", "value").alias("cpu")
    at = _field(r"\s(\d+\.\d+):\s", "double", "value").alias("timestamp")
    wanted = ("prev_comm", "prev_pid", "prev_state", "next_comm", "next_pid")
    return found.select(*[_field(FIELDS[n][0], "string", "value").alias(n) for n in wanted], cpu, at, "place")


def write_events(events: DataFrame, path: str, partition_ns: int = PARTITION_NS, width: int = 1) -> None:
    """Stores events as Parquet by time, sorted by cpu and ts, so that scans skip by partition and by statistics.

    A folder holds width partitions of time and is named by the first.
    """
    by_time = events.withColumn("ts_part", F.floor(F.col("ts") / (partition_ns * width)) * width)
    by_time.repartitionByRange("ts_part", "cpu", "ts").sortWithinPartitions("ts_part", "cpu", "ts").write.mode("overwrite").partitionBy("ts_part").parquet(path)


def within(events: DataFrame, start: int | None = None, end: int | None = None, partition_ns: int = PARTITION_NS) -> DataFrame:
    """Events with start <= ts <= end; where they have ts_part, as stored ones do, whole partitions outside are not read."""
    stored = "ts_part" in events.columns
    width = events.schema["ts_part"].metadata.get("width", 1) if stored else 1
    if start is not None:
        events = events.where((F.col("ts_part") >= start // (partition_ns * width) * width) & (F.col("ts") >= start) if stored else F.col("ts") >= start)
    if end is not None:
        events = events.where((F.col("ts_part") <= end // partition_ns) & (F.col("ts") <= end) if stored else F.col("ts") <= end)
    return events


def read_events(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, partition_ns: int = PARTITION_NS) -> DataFrame:
    """Stored events with their partition ts_part, those with start <= ts <= end if given; of an index, what it holds."""
    stored = Index(spark, path)
    found = stored.events() if stored.files() is not None else spark.read.parquet(path)
    return within(found, start, end, partition_ns)


def counters(lines: DataFrame) -> DataFrame:
    """One row on a trace text: lines, events, switches and skipped (lines that are no events), in one pass over the text."""
    # a line's parts, as parse_events() takes it apart; null where it is skipped
    usable = ~F.col("value").startswith("#") & (F.col("value") != "") & ~F.contains("value", F.lit("buffer started"))
    parts = F.when(usable, F.split(F.regexp_replace("value", LINE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n", 6))
    each = lines.select(F.explode_outer(F.array(parts)).alias("p"))
    event = (F.size("p") == 6) & F.col("p")[4].try_cast("decimal(20,9)").isNotNull()
    switch = event & F.regexp_extract(F.col("p")[5], r"^([^\s:]+):", 1).eqNullSafe("sched_switch")
    found = each.agg(F.count("*").alias("lines"), F.count_if(event).alias("events"), F.count_if(switch).alias("switches"))
    return found.select("lines", "events", "switches", (F.col("lines") - F.col("events")).alias("skipped"))


def write_counted(frame: DataFrame, path: str, name: str = "rows") -> dict[str, float]:
    """Writes a frame as text lines (column value) or else as Parquet, and says rows, seconds and rows_per_second.

    The rows are counted while they are written.
    """
    seen, begun = Observation(name), time.perf_counter()
    writer = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.text if frame.columns == ["value"] else writer.parquet)(path)
    rows, seconds = seen.get["rows"], time.perf_counter() - begun
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else 0.0}


# Fixed value: the base time of a kernel log.
BASE = "2026-01-09T10:38:15Z"


def kernel_log(lines: DataFrame, base: str = BASE) -> DataFrame:
    """Rows of a kernel log (value, place): each event's time on top of a base time, its CPU as written, task and message."""
    micros = F.unix_micros(F.to_timestamp(F.lit(base))) + F.round(F.col("ts_sec") * 1_000_000).cast("long")
    at = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.concat(at, F.lit(" ftrace: [CPU "), "cpu_text", F.lit("] "), "task", F.lit("-"), F.col("pid").cast("string"), F.lit(": "), "message")
    return parse_events(lines).select(text.alias("value"), "place")


def kernel_log_header(base: str = BASE) -> str:
    """The first line of a kernel log: its window of half an hour."""
    end = (datetime.fromisoformat(base.replace("Z", "+00:00")) + timedelta(minutes=30)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return f"window={base}-{end} start_utc={base} end_utc={end} tag=ftrace_transform"


def write_kernel_log(lines: DataFrame, path: str, base: str = BASE, single: bool = False) -> dict[str, float]:
    """Writes a kernel log in the order of the lines: a folder of text parts, the header first, or one file.

    Rows are dealt out by ranges of place and sorted within, so the parts one after another are the log, however large.
    Rows are counted while they are written: rows (events), seconds and rows_per_second. single: one task writes one file.
    """
    spark, begun, seen = lines.sparkSession, time.perf_counter(), Observation("kernel log")
    rows = kernel_log(lines, base)
    # a place that is null comes before all others
    header = spark.range(1).select(F.lit(kernel_log_header(base)).alias("value"), F.lit(None).cast(rows.schema["place"].dataType).alias("place"))
    ordered = header.union(rows).repartitionByRange(F.col("place").asc_nulls_first()).sortWithinPartitions(F.col("place").asc_nulls_first()).select("value")
    ordered = ordered.observe(seen, (F.count(F.lit(1)) - 1).alias("rows"))  # after the ranges, which take a sample of their own
    if single:
        Index(spark, path).write_one(ordered)
    else:
        ordered.write.mode("overwrite").text(path)
    count, seconds = seen.get["rows"], time.perf_counter() - begun
    return {"rows": count, "seconds": seconds, "rows_per_second": count / seconds if seconds else 0.0}
