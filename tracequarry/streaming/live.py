"""Trace text as a stream: counts by time, quiet spells, and runs paired across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.ftrace import parse_events

RUNS = "cpu int, pid long, comm string, ts long, dur long, end_state string"


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they appear in a folder; place is the file and the order within its batch."""
    lines = spark.readStream.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select("value", F.struct("file_path", "file_block_start").alias("place"))


def timed(lines: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Events with at, their time as a timestamp (microseconds from the epoch), and a watermark on it."""
    return parse_events(lines).withColumn("at", F.timestamp_micros((F.col("ts") / 1000).cast("long"))).withWatermark("at", late)


def counts(events: DataFrame, window: str = "1 second") -> DataFrame:
    """Events of each CPU and kind in windows of time: start, cpu, event, count."""
    found = events.groupBy(F.window("at", window), "cpu", "event").agg(F.count("*").alias("count"))
    return found.select(F.col("window.start").alias("start"), "cpu", "event", "count")


def active_spells(events: DataFrame, quiet: str = "5 milliseconds") -> DataFrame:
    """Spells of each CPU without a pause of quiet: start, end (last event plus quiet), cpu, count."""
    found = events.groupBy(F.session_window("at", quiet), "cpu").agg(F.count("*").alias("count"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "cpu", "count")


def _paired(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Runs that end within a batch; the one that goes on stays in the state. Events from before it came too late."""
    open_run = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    found = []
    for ts, state_before, pid, comm in zip(rows["ts"], rows["prev_state"], rows["next_pid"], rows["next_comm"], strict=True):
        if open_run is not None:
            if ts < open_run[0]:
                continue
            found.append((key[0], open_run[1], open_run[2], open_run[0], int(ts) - open_run[0], state_before))
        open_run = (int(ts), int(pid), comm)
    if open_run is not None:
        state.update(open_run)
    yield pd.DataFrame(found, columns=[c.split()[0] for c in RUNS.split(", ")])


def runs(events: DataFrame) -> DataFrame:
    """Runs of threads on each CPU, each as soon as the switch that ends it is seen."""
    switches = events.where("event = 'sched_switch' AND next_pid IS NOT NULL").select("cpu", "ts", "prev_state", "next_pid", "next_comm")
    return switches.groupBy("cpu").applyInPandasWithState(_paired, RUNS, "ts long, pid long, comm string", "append", GroupStateTimeout.NoTimeout)
