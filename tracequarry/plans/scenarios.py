"""The fixed performance scenarios over trace tables, each a plan from the tables by name to a result.

Every order is total: ties go by name or id. Averages are whole sums divided once, so they don't depend on the order of
addition. Where a pack of literals fits one kind of trace (names, categories, thresholds), it is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import neighbour
from ..functions.text import glob

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Scenario:
    """A numbered question, what it is for, and its plan."""

    number: int
    title: str
    goal: str
    plan: Callable[..., DataFrame]


SCENARIOS: dict[int, Scenario] = {}


def _scenario(number: int, title: str, goal: str) -> Callable:
    def keep(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SCENARIOS[number] = Scenario(number, title, goal, plan)
        return plan

    return keep


def mean(column: str) -> Column:
    """The average of whole numbers, from their exact sum, which may pass 64 bits."""
    return F.sum(F.col(column).cast("decimal(19,0)")).cast("double") / F.nullif(F.count(column), F.lit(0)).cast("double")


def ranked(frame: DataFrame, by: str, *ties: str) -> DataFrame:
    """Rows by a column downwards, nulls last, ties by more columns upwards."""
    return frame.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_first(t) for t in ties])


def top(frame: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The first n rows of ranked()."""
    return ranked(frame, by, *ties).limit(n)


def by_pattern(column: str, patterns: Sequence[str]) -> Column:
    """Whether a name matches one of the shell patterns."""
    found = F.lit(False)
    for p in patterns:
        found = found | glob(column, p)
    return found


@_scenario(1, "CPU busy share", "which CPUs carry the load")
def cpu_busy(t: Tables) -> DataFrame:
    used = t["sched"].groupBy("cpu").agg(F.sum("dur").alias("used"))
    total = t["sched"].agg(F.sum("dur").alias("total"))
    share = F.expr("try_divide(100D * used, CAST(total AS DOUBLE))")
    return used.join(F.broadcast(total)).select("cpu", (F.col("used") / F.lit(1e9)).alias("cpu_time_seconds"), share.alias("cpu_usage_percent")).orderBy(F.desc_nulls_last("cpu_time_seconds"), "cpu")


@_scenario(2, "Context switches", "how often CPUs change threads")
def context_switches(t: Tables) -> DataFrame:
    each = t["sched"].groupBy("cpu").agg(F.count("*").alias("ctx_switches"))
    span = t["sched"].agg((F.max("ts") - F.min("ts")).alias("span"))
    rate = F.expr("try_divide(CAST(ctx_switches AS DOUBLE), span / 1e9D)")
    return each.join(F.broadcast(span)).select("cpu", "ctx_switches", rate.alias("switches_per_sec")).orderBy(F.desc("ctx_switches"), "cpu")


def _by_thread(t: Tables, frame: DataFrame, *totals: Column) -> DataFrame:
    """Totals for each thread that has a row in thread; they are summed before the join, so few rows meet the names."""
    return frame.groupBy("utid").agg(*totals).join(t["thread"].select("utid", "name", "upid"), "utid")


@_scenario(3, "Short timeslices", "threads that run only briefly at a time")
def short_timeslices(t: Tables) -> DataFrame:
    found = _by_thread(t, t["sched"], mean("dur").alias("avg_slice_dur"), F.max("dur").alias("max_slice_dur"), F.count("*").alias("slice_count"))
    return found.orderBy(F.asc_nulls_first("avg_slice_dur"), "name", "utid").limit(20).select("name", "avg_slice_dur", "max_slice_dur", "slice_count")


def latencies(t: Tables) -> DataFrame:
    """The latency table, or one from thread_state if there is none."""
    if "sched_latency_for_running_interval" in t:
        return t["sched_latency_for_running_interval"]
    return t["thread_state"].where("state = 'R'").select("utid", F.col("dur").alias("latency_dur"))


@_scenario(4, "Scheduling latency", "threads that wait long for a CPU")
def scheduling_latency(t: Tables) -> DataFrame:
    found = _by_thread(t, latencies(t), mean("latency_dur").alias("avg_latency"), F.max("latency_dur").alias("max_latency"))
    return top(found, 20, "max_latency", "name", "utid").select("name", "avg_latency", "max_latency")


@_scenario(5, "Hard interrupts", "which interrupts fire most")
def hard_interrupts(t: Tables) -> DataFrame:
    found = t["linux_hard_irqs"].groupBy("name").agg(F.count("*").alias("count"), F.sum("dur").alias("total_dur"), mean("dur").alias("avg_dur"))
    return ranked(found, "count", "name")


@_scenario(6, "Soft interrupts", "time in deferred interrupt work")
def soft_interrupts(t: Tables) -> DataFrame:
    return ranked(t["linux_soft_irqs"].groupBy("name").agg(F.sum("dur").alias("total_dur"), mean("dur").alias("avg_dur")), "total_dur", "name")


@_scenario(7, "Running time", "threads that use most CPU time")
def running_time(t: Tables) -> DataFrame:
    found = _by_thread(t, t["sched"], F.sum("dur").alias("total_running_dur"))
    named = found.join(t["process"].select("upid", F.col("name").alias("process_name")), "upid", "left")
    return top(named, 10, "total_running_dur", "name", "utid").select("name", "process_name", "total_running_dur")


def _in_state(t: Tables, state: str, column: str) -> DataFrame:
    found = _by_thread(t, t["thread_state"].where(F.col("state") == state), F.sum("dur").alias(column))
    return top(found, 10, column, "name", "utid").select("name", column)


@_scenario(8, "Sleep time", "threads that sleep most")
def sleep_time(t: Tables) -> DataFrame:
    return _in_state(t, "S", "sleep_dur")


@_scenario(9, "Blocked time", "threads that can't be interrupted")
def blocked_time(t: Tables) -> DataFrame:
    return _in_state(t, "D", "d_state_dur")


@_scenario(10, "Lock waits", "slices that wait for locks")
def lock_waits(t: Tables, patterns: Sequence[str] = ("*lock*", "*contention*")) -> DataFrame:
    found = t["slice"].where(by_pattern("name", patterns)).groupBy("name").agg(F.sum("dur").alias("total_wait_dur"), F.count("*").alias("wait_count"))
    return ranked(found, "total_wait_dur", "name")


@_scenario(11, "Page faults", "counters of page faults")
def page_faults(t: Tables, like: str = "%page_fault%") -> DataFrame:
    tracks = t["counter_track"].where(F.col("name").ilike(like)).select(F.col("id").alias("track_id"), "name")
    values = t["counter"].select("track_id", F.col("value").cast("decimal(28,6)").alias("value"))
    return values.join(tracks, "track_id").groupBy("name").agg(F.sum("value").cast("double").alias("total_faults"))


def _latency_by_name(frame: DataFrame, average: str, most: str, count: str | None = None) -> DataFrame:
    return frame.groupBy("name").agg(mean("dur").alias(average), F.max("dur").alias(most), *([F.count("*").alias(count)] if count else []))


@_scenario(12, "Block IO latency", "slow block operations")
def block_io_latency(t: Tables, category: str = "block_io") -> DataFrame:
    return ranked(_latency_by_name(t["slice"].where(F.col("category") == category), "avg_latency", "max_latency"), "avg_latency", "name")


@_scenario(13, "System call latency", "slow system calls")
def syscall_latency(t: Tables, category: str = "syscall") -> DataFrame:
    return top(_latency_by_name(t["slice"].where(F.col("category") == category), "avg_dur", "max_dur", "call_count"), 20, "avg_dur", "name")


@_scenario(14, "Hot functions", "time in slices without their children")
def hot_functions(t: Tables) -> DataFrame:
    return top(t["_slice_flattened"].groupBy("name").agg(F.sum("dur").alias("self_time")), 20, "self_time", "name")


@_scenario(15, "Interrupts by CPU", "how interrupts are spread")
def interrupts_by_cpu(t: Tables) -> DataFrame:
    tracks = t["track"].where("type = 'cpu_irq'").select(F.col("id").alias("track_id"), F.col("name").alias("track_name"))
    counted = t["slice"].groupBy("track_id").agg(F.count("*").alias("n"))
    return ranked(counted.join(tracks, "track_id").groupBy("track_name").agg(F.sum("n").alias("irq_count")), "irq_count", "track_name")


@_scenario(16, "Zombies and exits", "threads that ended")
def zombies(t: Tables) -> DataFrame:
    found = _by_thread(t, t["thread_state"].where("state IN ('Z', 'X')"), F.count("*").alias("n"))
    return ranked(found.groupBy("name").agg(F.sum("n").alias("zombie_count")), "zombie_count", "name")


@_scenario(17, "Memory reclaim", "slices that reclaim memory")
def memory_reclaim(t: Tables, patterns: Sequence[str] = ("*kswapd*", "*reclaim*")) -> DataFrame:
    found = t["slice"].where(by_pattern("name", patterns)).groupBy("name").agg(F.sum("dur").alias("total_dur"), F.count("*").alias("count"))
    return ranked(found, "total_dur", "name")


@_scenario(18, "IO operations", "counts of block operations")
def io_operations(t: Tables, category: str = "block_io") -> DataFrame:
    return ranked(t["slice"].where(F.col("category") == category).groupBy("name").agg(F.count("*").alias("io_count")), "io_count", "name")


@_scenario(19, "Throttling latency", "latencies in the band of a quota's period")
def throttling_latency(t: Tables, low: int = 5_000_000, high: int = 10_000_000) -> DataFrame:
    over = latencies(t).where(F.col("latency_dur") > low)
    inside = F.col("latency_dur") <= high
    totals = (F.count("*").alias("latency_count_total"), F.count_if(inside).alias("count_5ms_10ms"), F.count_if(~inside).alias("count_over_10ms"), F.max("latency_dur").alias("max_latency"), mean("latency_dur").alias("avg_latency"))
    found = top(_by_thread(t, over, *totals), 20, "count_5ms_10ms", "name", "utid")
    return found.select(F.col("name").alias("thread_name"), "latency_count_total", "count_5ms_10ms", "count_over_10ms", "max_latency", "avg_latency")


def _wake_edges(t: Tables) -> DataFrame:
    edges = t["thread_state"].where("state = 'R'").groupBy("waker_utid", "utid").agg(F.count("*").alias("n"))
    names = t["thread"].select("utid", "name")
    woken = edges.join(names.withColumnRenamed("name", "wakee_thread"), "utid")
    return woken.join(names.select(F.col("utid").alias("waker_utid"), F.col("name").alias("waker_thread")), "waker_utid")


@_scenario(20, "Wake-up relations", "who wakes whom")
def wake_relations(t: Tables) -> DataFrame:
    found = _wake_edges(t).groupBy("waker_thread", "wakee_thread").agg(F.sum("n").alias("wake_count"))
    return top(found, 20, "wake_count", "waker_thread", "wakee_thread")


@_scenario(21, "Futex contention", "user-space lock calls")
def futex(t: Tables, like: str = "sys_futex%") -> DataFrame:
    return ranked(t["slice"].where(F.col("name").ilike(like)).groupBy("name").agg(F.count("*").alias("count"), mean("dur").alias("avg_dur")), "count", "name")


@_scenario(22, "Long blocks", "threads blocked for seconds")
def long_blocks(t: Tables, over: int = 5_000_000_000) -> DataFrame:
    found = t["thread_state"].where((F.col("state") == "D") & (F.col("dur") > over)).join(t["thread"].select("utid", "name"), "utid")
    return top(found, 20, "dur", "ts", "utid").select("name", "state", "dur", "ts")


@_scenario(23, "Kernel allocation", "slow memory allocation")
def allocation(t: Tables, names: Sequence[str] = ("*alloc*",), categories: Sequence[str] = ("*kmem*", "*mm*")) -> DataFrame:
    found = t["slice"].where(by_pattern("name", names) & by_pattern("category", categories))
    return ranked(found.groupBy("name").agg(F.count("*").alias("count"), mean("dur").alias("avg_dur"), F.max("dur").alias("max_dur")), "avg_dur", "name")


@_scenario(24, "Trace span", "length and size of the trace")
def trace_span(t: Tables) -> DataFrame:
    return t["sched"].agg(((F.max("ts") - F.min("ts")) / F.lit(1e9)).alias("duration_sec"), F.count("*").alias("sched_events"))


@_scenario(25, "Slice categories", "what was traced")
def slice_categories(t: Tables) -> DataFrame:
    return t["slice"].groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("category"))


@_scenario(26, "Stack depth", "how deep slices nest")
def stack_depth(t: Tables) -> DataFrame:
    return t["slice"].groupBy("depth").agg(F.count("*").alias("count")).orderBy(F.desc_nulls_last("depth"))


@_scenario(27, "Longest slices", "single slow slices")
def longest_slices(t: Tables) -> DataFrame:
    return top(t["slice"].select("name", "dur", "ts", "id"), 20, "dur", "ts", "name", "id").select("name", "dur", "ts")


@_scenario(28, "CPU time by process", "processes that use most CPU time; unknown ones together")
def cpu_by_process(t: Tables) -> DataFrame:
    found = _by_thread(t, t["sched"], F.sum("dur").alias("used")).join(t["process"].select("upid", F.col("name").alias("process_name")), "upid", "left")
    return top(found.groupBy("process_name").agg((F.sum("used") / F.lit(1e9)).alias("cpu_time_sec")), 20, "cpu_time_sec", "process_name")


@_scenario(29, "Active threads", "how many threads ran")
def active_threads(t: Tables) -> DataFrame:
    return t["sched"].agg(F.count_distinct("utid").alias("active_threads_count"))


@_scenario(30, "Timeline gaps", "where the trace may have lost events")
def timeline_gaps(t: Tables, width: int = 10**9) -> DataFrame:
    found = neighbour(t["sched"].select("ts", "id"), [], "ts", ["id"], ["ts"], "before", width, -1)
    return top(found.select("ts", (F.col("ts") - F.col("before.ts")).alias("gap")), 10, "gap", "ts")


@_scenario(31, "CPU time of known processes", "as scenario 28, without unknown processes")
def cpu_by_known_process(t: Tables) -> DataFrame:
    found = _by_thread(t, t["sched"], F.sum("dur").alias("used")).join(t["process"].select("upid", F.col("name").alias("process_name")), "upid")
    return top(found.groupBy("process_name").agg((F.sum("used") / F.lit(1e9)).alias("cpu_sec")), 10, "cpu_sec", "process_name")


@_scenario(32, "Runnable time", "latency straight from thread states")
def runnable_time(t: Tables) -> DataFrame:
    found = _by_thread(t, t["thread_state"].where("state = 'R'"), F.max("dur").alias("max_latency"), mean("dur").alias("avg_latency"))
    return top(found, 10, "max_latency", "name", "utid").select("name", "max_latency", "avg_latency")


@_scenario(33, "Slices over a limit", "slices longer than 10 ms")
def slices_over(t: Tables, over: int = 10_000_000) -> DataFrame:
    found = top(t["slice"].where(F.col("dur") > over).select("name", "dur", "ts", "id"), 10, "dur", "ts", "name", "id")
    return found.select("name", (F.col("dur") / F.lit(1e6)).alias("dur_ms"))


@_scenario(34, "Wake-up chain", "wake-ups by the names of both sides")
def wake_chain(t: Tables) -> DataFrame:
    found = _wake_edges(t).groupBy(F.col("waker_thread").alias("waker"), F.col("wakee_thread").alias("wakee")).agg(F.sum("n").alias("count"))
    return top(found, 10, "count", "waker", "wakee")


@_scenario(35, "Named slices over a limit", "slices of one name longer than 1 ms")
def named_slices_over(t: Tables, name: str = "sys_read", over: int = 1_000_000) -> DataFrame:
    return t["slice"].where((F.col("name") == name) & (F.col("dur") > over)).select("ts", "dur", "name")


@_scenario(36, "Table sizes", "rows of sched and of slice")
def table_sizes(t: Tables) -> DataFrame:
    return t["sched"].agg(F.count("*").alias("sched_rows")).join(t["slice"].agg(F.count("*").alias("slice_rows")))
