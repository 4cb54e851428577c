"""Progress of jobs while they run, from the counts that tasks report to the driver."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Rows after which progress is told, and seconds between two looks.
EVERY, LOOK = 100_000, 0.5


class Progress:
    """Tells how many rows the jobs that run inside have read and written so far: report(read, written, seconds).

    Tasks count what they read and write and send it with their heartbeats and their end; this asks the status store, so
    jobs run as they would without it. It tells when EVERY more rows were read, and once at the end.
    """

    def __init__(self, spark: SparkSession, report: Callable[[int, int, float], None], every: int = EVERY, look: float = LOOK):
        self.context, self.report, self.every, self.look = spark.sparkContext, report, every, look
        self.group = f"progress-{uuid.uuid4().hex}"
        self.done = threading.Event()

    def counts(self) -> tuple[int, int]:
        """Rows read and written so far, over all stages of the jobs."""
        tracker, store = self.context.statusTracker(), self.context._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup(self.group) for info in [tracker.getJobInfo(job)] if info for s in info.stageIds}
        read = written = 0
        for stage in stages:
            try:
                found = store.lastStageAttempt(stage)
            except Exception:  # a stage that was skipped or hasn't begun has no counts
                continue
            read, written = read + found.inputRecords(), written + found.outputRecords()
        return read, written

    def _watch(self) -> None:
        told = 0
        while not self.done.wait(self.look):
            read, written = self.counts()
            if read >= told + self.every:
                told = read
                self.report(read, written, time.perf_counter() - self.begun)

    def __enter__(self) -> Progress:
        self.begun, self.before = time.perf_counter(), self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(self.group, "rows are counted")
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self.done.set()
        self.thread.join()
        self.report(*self.counts(), time.perf_counter() - self.begun)
        self.context.setLocalProperty("spark.jobGroup.id", self.before)
