"""Events that come at regular intervals, by key: candidates from a histogram of gaps, judged by autocorrelation.

An event has a partner if another of its key follows one period later, within a tolerance. A periodic key has many, and few
at three quarters and five quarters of the period; in events at random, bursts too, the three are alike. The partner is the
last event known at the end of the tolerance, so a key's events are never compared with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import last_known, neighbour
from ..functions.store import kept

#: Candidates of a key, the tolerance as a part of the period, and the least share and significance of a period.
CANDIDATES, TOLERANCE, LEAST_SHARE, LEAST_Z = 3, 16, 0.3, 6.0
#: Nanoseconds of a window's bucket.
WIDTH = 10**9
#: Eighths of an octave that a gap's bin is.
PARTS = 8


def gap_bins(events: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Histogram of the gaps between neighbours of a key: key, bin, n and total (the gaps' sum).

    Bins are eighths of an octave, by whole numbers only: the power of two in a gap, times 8, and the next three bits.
    """
    gaps = neighbour(events.select(key, "ts"), [key], "ts", [], ["ts"], "next", width).select(key, (F.col("next.ts") - F.col("ts")).alias("gap")).where("gap >= 8")
    power = F.length(F.bin("gap")) - 1
    each = gaps.withColumn("bin", (power * PARTS + F.expr(f"shiftright(gap, CAST(length(bin(gap)) - 4 AS int)) - {PARTS}")).cast("long"))
    return each.groupBy(key, "bin").agg(F.count("*").alias("n"), F.sum("gap").alias("total"))


def periods(events: DataFrame, key: str, width: int = WIDTH, least: int = 30) -> DataFrame:
    """Candidate periods of events(key, ts) with at least so many events: key, period_ns, events, partners (events with one
    a period later), share (of those that can have one), control_share (the same at other intervals), z and periodic.

    A candidate is the mean gap of a bin of the histogram and its two neighbours, for the fullest bins. z is how many
    standard deviations partners exceed what the controls let expect, by the normal approximation; periodic says that share
    and z reach their least. Rows without key or time don't count; events of one time count each.
    """
    events = kept(events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, "ts"), "times")
    bins = gap_bins(events, key, width)
    near = bins.withColumn("x", F.explode(F.expr("array(bin - 1, bin, bin + 1)"))).groupBy(key, F.col("x").alias("bin")).agg(F.sum("n").alias("near"), F.sum("total").alias("sum"), F.sum(F.when(F.col("x") == F.col("bin"), F.col("n"))).alias("own"))
    # a key has some hundred bins at most
    order = Window.partitionBy(key).orderBy(F.desc("near"), F.desc("own"), "bin")
    chosen = near.where("own > 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= CANDIDATES).select(key, "nth", F.expr("sum div near").alias("period"))
    span = events.groupBy(key).agg(F.count("*").alias("events"), F.max("ts").alias("last")).where(F.col("events") >= least)
    wanted = kept(chosen.join(span, key), "candidates")
    tolerance = F.greatest(F.lit(1), F.expr(f"period div {TOLERANCE}"))
    # one row as what can be found, and one for each interval that looks for it
    looks = F.expr("array(CAST(NULL AS BIGINT), period, period * 3 div 4, period * 5 div 4)")
    each = events.join(wanted, key).select(key, "nth", "ts", "last", tolerance.alias("tolerance"), F.posexplode(looks).alias("which", "lag"))
    each = each.withColumn("at", F.when(F.col("lag").isNull(), F.col("ts")).otherwise(F.col("ts") + F.col("lag") + F.col("tolerance"))).where("lag IS NULL OR at <= last")
    known = last_known(each, [key, "nth"], "at", ["which"], F.when(F.col("lag").isNull(), F.col("ts")), "known", width).where("lag IS NOT NULL")
    hit = F.col("known") >= F.col("ts") + F.col("lag") - F.col("tolerance")
    sums = known.groupBy(key, "nth").agg(
        F.count_if(F.col("which") == 1).alias("able"), F.count_if((F.col("which") == 1) & hit).alias("partners"), F.count_if(F.col("which") > 1).alias("control"), F.count_if((F.col("which") > 1) & hit).alias("control_hits"),
    )
    p = (F.col("control_hits") + 0.5) / (F.col("control") + 1)
    found = wanted.join(sums, [key, "nth"], "left").withColumns({"able": F.coalesce("able", F.lit(0)), "partners": F.coalesce("partners", F.lit(0)), "control": F.coalesce("control", F.lit(0)), "control_hits": F.coalesce("control_hits", F.lit(0))})
    z = (F.col("partners") - F.col("able") * p) / F.sqrt(F.greatest(F.lit(1.0), F.col("able") * p * (1 - p)))
    found = found.withColumns({"share": F.col("partners") / F.greatest(F.col("able"), F.lit(1)), "control_share": F.col("control_hits") / F.greatest(F.col("control"), F.lit(1)), "z": z})
    return found.select(key, F.col("period").alias("period_ns"), "events", "partners", "share", "control_share", "z", ((F.col("share") >= LEAST_SHARE) & (F.col("z") >= LEAST_Z)).alias("periodic"))
