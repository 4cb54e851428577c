"""The frequency report over sched_switch lines: names, virtualisation, CPUs, blocked threads, states, summary.

Input is what parse_switches() returns. Ties keep the order in which the lines first say them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import VIRTUALISATION, busy_level, state_text

#: Names that a list of the most frequent ones has, and shares of blocked switches that count as many and as some.
TOP, MANY_BLOCKED, SOME_BLOCKED = 20, 5, 1


def _counted(frame: DataFrame, column: str) -> DataFrame:
    """Value, count, percent of all with a value, and the first place of each value of a column."""
    each = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"), F.min("place").alias("first"))
    total = each.agg(F.sum("count").alias("total"))
    return each.join(F.broadcast(total)).withColumn("percent", F.lit(100.0) * F.col("count") / F.col("total")).drop("total")


def frequent(switches: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """The n most frequent values of next_comm or prev_comm: comm, count, percent."""
    return _counted(switches, column).orderBy(F.desc("count"), "first").limit(n).select(F.col(column).alias("comm"), "count", "percent")


def virtualisation(switches: DataFrame) -> DataFrame:
    """How often names say a word of virtualisation, once for each word: comm, count, first said first among equals."""
    names = F.array(F.struct(F.col("prev_comm").alias("comm"), F.lit(0).alias("side")), F.struct(F.col("next_comm").alias("comm"), F.lit(1).alias("side")))
    each = switches.select("place", F.explode(names).alias("x")).where("x.comm IS NOT NULL").groupBy("x.comm").agg(F.count("*").alias("seen"), F.min(F.struct("place", "x.side")).alias("first"))
    words = sum((F.contains(F.lower("comm"), F.lit(w)).cast("long") for w in VIRTUALISATION), F.lit(0).cast("long"))
    return each.withColumn("count", F.col("seen") * words).where("count > 0").orderBy(F.desc("count"), "first").select("comm", "count")


def by_cpu(switches: DataFrame) -> DataFrame:
    """Events of each CPU in the order of their numbers: cpu (as written), count, percent, level."""
    found = _counted(switches, "cpu").withColumn("level", busy_level(F.col("percent")))
    return found.orderBy(F.col("cpu").cast("int"), "cpu").select("cpu", "count", "percent", "level")


def busiest_cpu(switches: DataFrame) -> DataFrame:
    """The CPU with most events."""
    return _counted(switches, "cpu").orderBy(F.desc("count"), "first").limit(1).select("cpu", "count", "percent")


def blocked(switches: DataFrame) -> DataFrame:
    """Switches away in state D by name: comm, count, percent of all switches together (share) and its verdict."""
    each = switches.where("prev_state = 'D' AND prev_comm IS NOT NULL").groupBy(F.col("prev_comm").alias("comm")).agg(F.count("*").alias("count"), F.min("place").alias("first"))
    share = switches.agg((F.lit(100.0) * F.count_if(F.expr("prev_state = 'D' AND prev_comm IS NOT NULL")) / F.nullif(F.count("*"), F.lit(0))).alias("share"))
    verdict = F.when(F.col("share") > MANY_BLOCKED, "warning").when(F.col("share") > SOME_BLOCKED, "notice").otherwise("normal")
    return each.join(F.broadcast(share)).orderBy(F.desc("count"), "first").select("comm", "count", "share", verdict.alias("verdict"))


def states(switches: DataFrame) -> DataFrame:
    """States of switches away: state, count, percent, description."""
    return _counted(switches, "prev_state").orderBy(F.desc("count"), "first").select(F.col("prev_state").alias("state"), "count", "percent", state_text("prev_state").alias("description"))


def summary(switches: DataFrame) -> DataFrame:
    """One row: total_events, most_active and its count, busiest_cpu and its count, blocked_names, virtualisation (words in names)."""
    active = frequent(switches, "next_comm", 1).select(F.col("comm").alias("most_active"), F.col("count").alias("most_active_count"))
    cpu = busiest_cpu(switches).select(F.col("cpu").alias("busiest_cpu"), F.col("count").alias("busiest_cpu_count"))
    whole = switches.agg(F.count("*").alias("total_events"), F.count_distinct(F.when(F.col("prev_state") == "D", F.col("prev_comm"))).alias("blocked_names"))
    machines = virtualisation(switches).agg(F.count("*").alias("virtualisation_names"))
    always = F.lit(True)
    return whole.join(machines).join(active, always, "left").join(cpu, always, "left")


def report_lines(switches: DataFrame) -> Iterator[str]:
    """The report as text, a line at a time; only the lists of most frequent names have a number of rows that is fixed."""
    sections = (
        ("next_comm", frequent(switches, "next_comm")), ("prev_comm", frequent(switches, "prev_comm")), ("virtualisation", virtualisation(switches)),
        ("cpu", by_cpu(switches)), ("blocked", blocked(switches)), ("states", states(switches)), ("summary", summary(switches)),
    )
    for name, frame in sections:
        yield f"[{name}]"
        for r in frame.toLocalIterator():
            yield ", ".join(f"{c}={v:.2f}" if isinstance(v, float) else f"{c}={v}" for c, v in r.asDict().items())
        yield ""
