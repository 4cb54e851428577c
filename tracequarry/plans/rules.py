"""Verdicts on the figures of scenarios by fixed thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import neighbour

# Figure, comparison and threshold from which it is abnormal; nanoseconds where it is a time.
THRESHOLDS = (
    ("cpu_usage_percent", ">", 90.0),
    ("switches_per_sec", ">", 10_000.0),
    ("avg_slice_dur", "<", 1_000_000.0),
    ("max_latency", ">", 10_000_000.0),
    ("hard_irq_dur", ">", 1_000_000.0),
    ("lock_wait_dur", ">", 100_000_000.0),
    ("hdd_latency", ">", 10_000_000.0),
    ("ssd_latency", ">", 1_000_000.0),
    ("syscall_dur", ">", 100_000_000.0),
    ("function_share", ">", 0.3),
)
#: Utilisation of a CPU beside which others count as idle, and share of interrupts on one CPU that counts as concentrated.
BUSY_CPU, IDLE_CPU, ONE_CPU = 90.0, 10.0, 0.5
STALLS = ((1_000_000, "system"), (100_000, "noticeable"), (10_000, "short"))


def abnormal(figure: str, value: Column | str) -> Column:
    """Whether a figure is beyond its threshold; null stays null."""
    sign, limit = next((s, t) for f, s, t in THRESHOLDS if f == figure)
    value = F.col(value) if isinstance(value, str) else value
    return value > limit if sign == ">" else value < limit


def stall_level(ns: Column | str) -> Column:
    """How far a stall is felt: normal, short, noticeable or system; a value on a border belongs below it."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    found = F.when(ns > STALLS[0][0], STALLS[0][1])
    for least, name in STALLS[1:]:
        found = found.when(ns > least, name)
    return found.when(ns.isNotNull(), "normal")


def switch_meaning(state: Column | str) -> Column:
    """Why a thread left its CPU, by its state."""
    state = F.col(state) if isinstance(state, str) else state
    return F.when(state.startswith("R"), "preempted").when(state == "S", "sleeps").when(state == "D", "blocked").otherwise("other")


def verdicts(frame: DataFrame, figure: str, column: str) -> DataFrame:
    """Adds figure and abnormal to the rows of a scenario."""
    return frame.select("*", F.lit(figure).alias("figure"), F.coalesce(abnormal(figure, column), F.lit(False)).alias("abnormal"))


def backward_times(events: DataFrame, order: str = "place", key: str = "cpu", width: int = 10**6) -> DataFrame:
    """Events whose time is before that of the line above of the same CPU; order is a whole number."""
    found = neighbour(events.select(key, "ts", order), [key], order, [], ["ts"], "before", width, -1)
    return found.where(F.col("before.ts") > F.col("ts")).select(key, order, "ts", F.col("before.ts").alias("ts_before"))


def jumping_times(events: DataFrame, least_ns: int, order: str = "place", key: str = "cpu", width: int = 10**6) -> DataFrame:
    """Events whose time is least_ns or more after that of the line above of the same CPU."""
    found = neighbour(events.select(key, "ts", order), [key], order, [], ["ts"], "before", width, -1)
    return found.where(F.col("ts") - F.col("before.ts") >= least_ns).select(key, order, "ts", F.col("before.ts").alias("ts_before"))


def unbalanced(busy: DataFrame) -> DataFrame:
    """One row on CPUs (cpu, cpu_usage_percent of each): busy and idle ones, and whether one works while others are idle."""
    found = busy.agg(F.count_if(F.col("cpu_usage_percent") > BUSY_CPU).alias("busy_cpus"), F.count_if(F.col("cpu_usage_percent") < IDLE_CPU).alias("idle_cpus"))
    return found.withColumn("unbalanced", (F.col("busy_cpus") > 0) & (F.col("idle_cpus") > 0))


def concentrated(counts: DataFrame) -> DataFrame:
    """counts(track_name, irq_count) with the share of all interrupts, and whether one CPU has more than ONE_CPU of them."""
    total = counts.agg(F.sum("irq_count").alias("total"))
    return counts.join(F.broadcast(total)).select("track_name", "irq_count", (F.col("irq_count") / F.col("total")).alias("share"), (F.col("irq_count") / F.col("total") > ONE_CPU).alias("concentrated"))
