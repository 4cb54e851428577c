"""Analyses of a trace: gaps, load over time, contexts, single threads, and regular throttling.

Times are nanoseconds. Tables are those of derive.py; a gap of a thread is from the end of a run to its next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import last_known, neighbour, running_sums
from ..functions.text import process_type
from .derive import WIDTH

#: Kinds of a context, as the reports name them.
CONTEXTS = {"user": "user_process", "kernel_thread": "kernel_thread", "idle": "idle", "irq": "irq", "softirq": "softirq"}
#: Band of gaps that throttling by a quota leaves, least number of them, and spread up to which they count as regular.
QOS_BAND, QOS_GAPS, QOS_SPREAD = (4_000_000, 10_000_000), 5, 0.2
#: Bins of a stretch in which a long run is dealt out.
SPAN = 4096


def time_gaps(events: DataFrame, threshold_ns: int = 100_000, by: str | None = None, width: int = WIDTH) -> DataFrame:
    """Gaps between an event and the next one, of all CPUs together or of each (by='cpu'), above a threshold.

    Columns: the key, gap_start, gap_end, gap_ns, prev_event and next_event.
    """
    keys = [by] if by else []
    found = neighbour(events.select(*keys, "ts", "place", "event"), keys, "ts", ["place"], ["ts", "event"], "next", width)
    gaps = found.select(*keys, F.col("ts").alias("gap_start"), F.col("next.ts").alias("gap_end"), (F.col("next.ts") - F.col("ts")).alias("gap_ns"), F.col("event").alias("prev_event"), F.col("next.event").alias("next_event"))
    return gaps.where(F.col("gap_ns") > threshold_ns)


def time_gap_summary(gaps: DataFrame, share: float = 0.95, width: int = 10**6) -> DataFrame:
    """One row: total_gaps, max_gap_ns and p95_gap_ns, exact and interpolated.

    The place of each length among all comes from running sums of how often each occurs, so no task holds all lengths.
    """
    counts = gaps.groupBy("gap_ns").agg(F.count("*").alias("n")).withColumn("below", F.col("n"))
    ranked = running_sums(counts, [], "gap_ns", [], ["below"], width)
    place = (F.col("total_gaps") - 1) * F.lit(share)
    total = gaps.agg(F.count("*").alias("total_gaps"), F.max("gap_ns").alias("max_gap_ns")).withColumn("low", F.floor(place)).withColumn("part", place - F.col("low"))
    holds = lambda k: F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("gap_ns"))
    near = ranked.join(F.broadcast(total), (F.col("below") <= F.col("low") + 1) & (F.col("below") + F.col("n") > F.col("low")))
    ends = near.agg(F.max(holds(F.col("low"))).alias("a"), F.max(holds(F.col("low") + 1)).alias("b"))
    return total.join(ends).select("total_gaps", "max_gap_ns", (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias("p95_gap_ns"))


def in_bins(runs: DataFrame, bin_ns: int, start: int | F.Column = 0) -> DataFrame:
    """Splits runs (ts, dur) at the borders of bins from start on: adds bin and overlap.

    A run over many bins is dealt out in stretches of SPAN bins first, so no row holds a list longer than that many.
    """
    begin, end = F.col("ts") - start, F.col("ts") + F.col("dur") - start
    first, last = F.floor(begin / F.lit(bin_ns)), F.floor((end - 1) / F.lit(bin_ns))
    stretches = runs.where("dur > 0").withColumn("bin", F.explode(F.sequence(F.floor(first / SPAN), F.floor(last / SPAN))))
    split = stretches.withColumn("bin", F.explode(F.sequence(F.greatest(first, F.col("bin") * SPAN), F.least(last, F.col("bin") * SPAN + SPAN - 1))))
    return split.withColumn("overlap", F.least(end, (F.col("bin") + 1) * bin_ns) - F.greatest(begin, F.col("bin") * bin_ns))


def time_distribution(sched: DataFrame, thread: DataFrame, bin_ns: int = 1_000_000) -> DataFrame:
    """Load of each bin of a trace with a switch or a run: bin, bin_start, event_count and cpu_util (busy share of all CPUs)."""
    span = sched.agg(F.min("ts").alias("t0"), F.count_distinct("cpu").alias("cpus"))
    idle = thread.where("is_idle").select("utid", F.lit(True).alias("idle"))
    timed = sched.join(F.broadcast(span)).withColumns({"ts": F.col("ts") - F.col("t0")})
    counts = timed.groupBy(F.floor(F.col("ts") / F.lit(bin_ns)).alias("bin"), "t0", "cpus").agg(F.count("*").alias("event_count"), F.lit(0).cast("long").alias("busy"))
    busy = in_bins(timed.join(idle, "utid", "left").where("idle IS NULL"), bin_ns).groupBy("bin", "t0", "cpus").agg(F.lit(0).cast("long").alias("event_count"), F.sum("overlap").alias("busy"))
    both = counts.union(busy).groupBy("bin", "t0", "cpus").agg(F.sum("event_count").alias("event_count"), F.sum("busy").alias("busy"))
    return both.select("bin", (F.col("t0") + F.col("bin") * bin_ns).alias("bin_start"), "event_count", (F.col("busy") / (F.lit(bin_ns) * F.col("cpus"))).alias("cpu_util"))


def hotspots(distribution: DataFrame, bin_ns: int = 1_000_000, threshold: float = 0.9, width_bins: int = 100_000) -> DataFrame:
    """Stretches of neighbouring bins with a load above the threshold: start, end, util (their mean)."""
    high = distribution.where(F.col("cpu_util") > threshold)
    marked = neighbour(high, [], "bin", [], ["bin"], "before", width_bins, -1)
    firsts = marked.withColumn("first", F.when(F.col("before").isNull() | (F.col("before.bin") < F.col("bin") - 1), F.col("bin")))
    grouped = last_known(firsts.drop("before"), [], "bin", [], F.col("first"), "island", width_bins)
    return grouped.groupBy("island").agg(F.min("bin_start").alias("start"), (F.max("bin_start") + bin_ns).alias("end"), F.avg("cpu_util").alias("util")).drop("island")


def contexts(sched: DataFrame, thread: DataFrame) -> DataFrame:
    """Share of the CPU time of each context, all five always: context, count (runs), threads and time_percent."""
    runs = sched.groupBy("utid").agg(F.count("*").alias("count"), F.sum("dur").alias("used"))
    named = runs.join(thread.select("utid", process_type("name", "tid").alias("kind")), "utid")
    each = named.groupBy("kind").agg(F.sum("count").alias("count"), F.count("*").alias("threads"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))
    every = sched.sparkSession.createDataFrame(list(CONTEXTS.items()), "kind string, context string")
    total = each.agg(F.sum("used").alias("total"))
    share = F.coalesce(F.expr("try_divide(100D * used, CAST(total AS DOUBLE))"), F.lit(0.0)).alias("time_percent")
    return every.join(each, "kind", "left").join(F.broadcast(total)).select("context", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("threads", F.lit(0)).alias("threads"), share)


def context_timeline(sched: DataFrame, thread: DataFrame, cpu: int) -> DataFrame:
    """Runs of one CPU: start, end, context, pid, comm."""
    names = thread.select("utid", F.col("tid").alias("pid"), F.col("name").alias("comm"), process_type("name", "tid").alias("kind"))
    kinds = F.create_map(*[F.lit(x) for p in CONTEXTS.items() for x in p])
    return sched.where(F.col("cpu") == cpu).join(names, "utid").select(F.col("ts").alias("start"), (F.col("ts") + F.col("dur")).alias("end"), kinds[F.col("kind")].alias("context"), "pid", "comm")


def cpu_time(sched: DataFrame, thread: DataFrame, pids: list[int]) -> DataFrame:
    """CPU time of each pid that ran: pid, time_ns, percent of the trace's length."""
    span = sched.agg((F.max(F.coalesce(F.col("ts") + F.col("dur"), F.col("ts"))) - F.min("ts")).alias("span"))
    own = thread.where(F.col("tid").isin(pids)).select("utid", F.col("tid").alias("pid"))
    used = sched.join(own, "utid").groupBy("pid").agg(F.coalesce(F.sum("dur"), F.lit(0)).alias("time_ns"))
    return used.join(F.broadcast(span)).select("pid", "time_ns", F.expr("try_divide(100D * time_ns, CAST(span AS DOUBLE))").alias("percent"))


def thread_runs(sched: DataFrame, thread: DataFrame, pid: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """The runs of a pid (ts, dur, cpu, utid), cut to start and end if given; runs without an end only count as begun."""
    own = thread.where(F.col("tid") == pid).select("utid")
    runs = sched.join(own, "utid", "left_semi").select("ts", "dur", "cpu", "utid", "id")
    stop = F.col("ts") + F.coalesce("dur", F.lit(0))
    if start is not None:
        runs = runs.where((stop > start) | (F.col("ts") >= start))
    if end is not None:
        runs = runs.where(F.col("ts") <= end)
    low = F.greatest(F.col("ts"), F.lit(start)) if start is not None else F.col("ts")
    high = F.least(stop, F.lit(end)) if end is not None else stop
    return runs.select(low.alias("ts"), F.when(F.col("dur").isNotNull(), high - low).alias("dur"), "cpu", "utid", "id")


def thread_running(sched: DataFrame, thread: DataFrame, pid: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row on a pid: is_running, run_time_ns, run_percent (of the range or the trace), sched_count, avg_timeslice_ns."""
    whole = sched.agg(F.min("ts").alias("t0"), F.max(F.coalesce(F.col("ts") + F.col("dur"), F.col("ts"))).alias("t1"))
    span = whole.select((F.lit(end) if end is not None else F.col("t1")).alias("b") - (F.lit(start) if start is not None else F.col("t0")).alias("a"))
    used = thread_runs(sched, thread, pid, start, end).agg(F.coalesce(F.sum("dur"), F.lit(0)).alias("run_time_ns"), F.count("*").alias("sched_count"), F.count("dur").alias("ended"))
    percent = F.coalesce(F.expr("try_divide(100D * run_time_ns, CAST(span AS DOUBLE))"), F.lit(0.0)).alias("run_percent")
    mean = F.coalesce(F.expr("try_divide(CAST(run_time_ns AS DOUBLE), CAST(ended AS DOUBLE))"), F.lit(0.0)).alias("avg_timeslice_ns")
    return used.join(F.broadcast(span.toDF("span"))).select((F.col("sched_count") > 0).alias("is_running"), "run_time_ns", percent, "sched_count", mean)


def thread_gaps(sched: DataFrame, thread: DataFrame, pid: int | None = None, threshold_ns: int = 1_000_000, width: int = WIDTH) -> DataFrame:
    """Times off the CPU of each thread, or of one pid, above a threshold: utid, pid, comm, gap_start, gap_end, duration_ns,
    cpu, end_state (with which it was last seen) and next_cpu (on which it is seen next)."""
    names = thread.select("utid", F.col("tid").alias("pid"), F.col("name").alias("comm"))
    runs = sched if pid is None else sched.join(names.where(F.col("pid") == pid).select("utid"), "utid", "left_semi")
    state = F.col("end_state") if "end_state" in sched.columns else F.lit(None).cast("string").alias("end_state")
    found = neighbour(runs.select("utid", "ts", "dur", "cpu", "id", state), ["utid"], "ts", ["id"], ["ts", "cpu"], "next", width)
    gaps = found.select("utid", (F.col("ts") + F.col("dur")).alias("gap_start"), F.col("next.ts").alias("gap_end"), "cpu", "end_state", F.col("next.cpu").alias("next_cpu")).withColumn("duration_ns", F.col("gap_end") - F.col("gap_start"))
    return gaps.where(F.col("duration_ns") > threshold_ns).join(names, "utid").select("utid", "pid", "comm", "gap_start", "gap_end", "duration_ns", "cpu", "end_state", "next_cpu")


def gap_activity(gaps: DataFrame, sched: DataFrame, thread: DataFrame, width: int = WIDTH) -> DataFrame:
    """What the CPU of each gap did meanwhile: adds dominant_context (the one with most time) and runs (how many fell into it).

    Gaps of threads that sleep overlap with nearly all runs, so gaps and runs never meet as pairs. Each end of a gap takes
    the CPU's busy time and runs so far, by context, from running sums over the CPU's runs, and the gap has what lies
    between: the work is in proportion to runs and gaps.
    """
    kinds, key = list(CONTEXTS), ["utid", "pid", "comm", "gap_start", "gap_end", "duration_ns", "cpu", "end_state", "next_cpu"]
    named = sched.where("dur > 0").join(thread.select("utid", process_type("name", "tid").alias("kind")), "utid")
    busy = [F.when(F.col("kind") == k, F.col("dur")).otherwise(0).alias(f"busy_{k}") for k in kinds]
    run = F.struct("ts", "dur", "kind").alias("run")
    runs = named.select("cpu", "ts", F.lit(1).alias("after"), F.lit(1).alias("n"), *busy, run, F.lit(None).alias("gap"), F.lit(None).cast("boolean").alias("is_end"))
    ends = gaps.select("cpu", F.struct(*key).alias("gap"), F.explode(F.array(F.struct(F.col("gap_start").alias("ts"), F.lit(False).alias("is_end")), F.struct(F.col("gap_end").alias("ts"), F.lit(True).alias("is_end")))).alias("x"))
    ends = ends.select("cpu", "x.ts", F.lit(0).alias("after"), F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(f"busy_{k}") for k in kinds], F.lit(None).alias("run"), "gap", "x.is_end")
    # of rows at one time, the ends come first: a run that begins there has done nothing yet
    summed = running_sums(runs.union(ends), ["cpu"], "ts", ["after", "run.ts", "gap", "is_end"], ["n", *[f"busy_{k}" for k in kinds]], width, F.col("run"))
    over = F.greatest(F.coalesce(F.col("last.ts") + F.col("last.dur") - F.col("ts"), F.lit(0)), F.lit(0))
    at = summed.where("gap IS NOT NULL").select("gap", "is_end", "n", (over > 0).alias("runs_on"), *[(F.col(f"busy_{k}") - F.when(F.col("last.kind") == k, over).otherwise(0)).alias(f"busy_{k}") for k in kinds])
    sign = F.when(F.col("is_end"), 1).otherwise(-1)
    running = F.when(~F.col("is_end") & F.col("runs_on"), 1).otherwise(0)
    sums = at.groupBy("gap").agg(F.sum(sign * F.col("n") + running).alias("runs"), *[F.sum(sign * F.col(f"busy_{k}")).alias(f"busy_{k}") for k in kinds])
    most = F.array_max(F.array(*[F.struct(F.col(f"busy_{k}").alias("busy"), F.lit(k).alias("kind"), F.lit(c).alias("context")) for k, c in CONTEXTS.items()]))
    return sums.where("runs > 0").select("gap.*", most["context"].alias("dominant_context"), "runs")


def gap_processes(gaps: DataFrame, sched: DataFrame, thread: DataFrame, bin_ns: int = WIDTH) -> DataFrame:
    """Names of the threads that ran in the gaps of one thread: gap_start, gap_end, cpu, processes (sorted, each once).

    The gaps of one thread don't overlap, so a run meets few of them; they find each other by CPU and bin of time.
    """
    runs = in_bins(sched.select("ts", "dur", "cpu", "utid"), bin_ns).join(thread.select("utid", F.col("name").alias("comm")), "utid").select("cpu", "bin", "comm", F.col("ts").alias("run_start"), (F.col("ts") + F.col("dur")).alias("run_end"))
    cut = in_bins(gaps.select("gap_start", "gap_end", "cpu").withColumns({"ts": F.col("gap_start"), "dur": F.col("gap_end") - F.col("gap_start")}), bin_ns)
    met = cut.join(runs, ["cpu", "bin"]).where("run_start < gap_end AND run_end > gap_start")
    return met.groupBy("gap_start", "gap_end", "cpu").agg(F.array_sort(F.collect_set("comm")).alias("processes"))


def qos_gaps(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per CPU the gaps between its events in the band that a quota leaves: cpu, gaps, avg_ns, sd_ns, confidence.

    confidence is high for QOS_GAPS regular gaps or more, medium for as many irregular ones, else low.
    """
    low, high = QOS_BAND
    found = time_gaps(events, low - 1, "cpu", width).where(F.col("gap_ns") <= high)
    each = found.groupBy("cpu").agg(F.count("*").alias("gaps"), F.avg("gap_ns").alias("avg_ns"), F.stddev_pop("gap_ns").alias("sd_ns"))
    regular = F.col("sd_ns") < QOS_SPREAD * F.col("avg_ns")
    return each.withColumn("confidence", F.when((F.col("gaps") >= QOS_GAPS) & regular, "high").when(F.col("gaps") >= QOS_GAPS, "medium").otherwise("low"))
