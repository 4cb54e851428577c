"""Requests that overlap: a begin and an end are told by a key and may lie on different CPUs, in any order.

Block requests are known by their device and first sector. Of one key, ends answer begins in the order in which they came;
an end before any open begin is ignored, as its begin lies before the trace. How many are open, and which begin an end
answers, are running counts of the key in time, so no key is one task, whatever its number of requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import neighbour, running_height, running_sums

#: Nanoseconds of a window's bucket.
WIDTH = 10**9

# Events of block requests; "8,0 WS 4096 () 1234 + 8 [comm]" and "8,0 WS () 1234 + 8 [0]" in their messages.
ISSUED, COMPLETED = "block_rq_issue", "block_rq_complete"
DEVICE, SECTORS = r":\s+(\d+),(\d+)\s+(\S+)", r"\s(\d+)\s\+\s(\d+)(?:\s|$)"
CATEGORY = "block_io"


def block_requests(events: DataFrame) -> DataFrame:
    """Begins and ends of block requests: ts, place, kind (B or E), track_id, device (as written), sector, sectors,
    operation (as written), name and category. A message without a sector has a null one, which is a key like any other."""
    found = events.where(F.col("event").isin(ISSUED, COMPLETED))
    part = lambda pattern, group: F.nullif(F.regexp_extract("message", pattern, group), F.lit(""))
    major, minor = part(DEVICE, 1).try_cast("long"), part(DEVICE, 2).try_cast("long")
    return found.select(
        "ts", "place", F.when(F.col("event") == ISSUED, "B").otherwise("E").alias("kind"), ((major * (1 << 20) + minor) * 4 + 2).alias("track_id"),
        F.concat_ws(",", part(DEVICE, 1), part(DEVICE, 2)).alias("device"), part(SECTORS, 1).try_cast("long").alias("sector"), part(SECTORS, 2).try_cast("long").alias("sectors"),
        part(DEVICE, 3).alias("operation"), F.lit(ISSUED).alias("name"), F.lit(CATEGORY).alias("category"),
    )


def devices(requests: DataFrame) -> DataFrame:
    """The devices of block requests as tracks: id, name and type."""
    return requests.groupBy(F.col("track_id").alias("id")).agg(F.concat(F.lit("block "), F.min("device")).alias("name"), F.lit("block").alias("type"), F.min("category").alias("event_type"))


def answered(requests: DataFrame, key: tuple[str, ...] = ("track_id", "sector"), width: int = WIDTH) -> DataFrame:
    """requests(ts, place, kind and the key's columns) without ends that answer nothing."""
    step = F.when(F.col("kind") == "B", 1).otherwise(-1)
    return running_height(requests, list(key), "ts", ["place"], step, "height", width).where("NOT height_lost").drop("height", "height_lost")


def paired(requests: DataFrame, width: int = WIDTH, key: tuple[str, ...] = ("track_id", "sector")) -> DataFrame:
    """The begins, each with dur, the time to the end that answers it; null for those that nothing answers.

    The n-th begin of a key and its n-th end that answers one meet in a group of two.
    """
    counted = answered(requests, key, width).withColumns({"begins": F.when(F.col("kind") == "B", 1).otherwise(0).cast("long"), "ends": F.when(F.col("kind") == "E", 1).otherwise(0).cast("long")})
    numbered = running_sums(counted, list(key), "ts", ["place"], ["begins", "ends"], width).withColumn("n", F.expr("IF(kind = 'B', begins, ends)"))
    own = [c for c in requests.columns if c != "kind"]
    begin, end = F.col("kind") == "B", F.max(F.when(F.col("kind") == "E", F.col("ts"))).alias("until")
    # a struct is alike where its nulls are, so a null sector groups
    pairs = numbered.groupBy(F.struct(*key).alias("of"), "n").agg(F.max(F.when(begin, F.struct(*own))).alias("x"), end).where("x IS NOT NULL")
    return pairs.select("x.*", (F.col("until") - F.col("x.ts")).alias("dur"))


def in_flight(requests: DataFrame, width: int = WIDTH, by: tuple[str, ...] = ("track_id",), key: tuple[str, ...] = ("track_id", "sector")) -> DataFrame:
    """How many requests are open between any two changes of a device: ts, dur, depth and the columns of by.

    A request that nothing answers stays open to the end. Stretches reach from the first change to the last.
    """
    step = answered(requests, key, width).select(*by, "ts", "place", F.when(F.col("kind") == "B", 1).otherwise(-1).cast("long").alias("step"))
    depth = running_sums(step.withColumn("before", F.col("step")), list(by), "ts", ["place"], ["before"], width)
    found = neighbour(depth.select(*by, "ts", "place", (F.col("before") + F.col("step")).alias("depth")), list(by), "ts", ["place"], ["ts"], "next", width)
    return found.where("next.ts > ts").select(*by, "ts", (F.col("next.ts") - F.col("ts")).alias("dur"), "depth")


def queue_depth(requests: DataFrame, width: int = WIDTH, limit: int = 32, rate_ns: int = 10**9) -> DataFrame:
    """For each device, how deep its queue is over time, and how many requests come.

    Returns track_id, device, requests (begins), mean_depth, median_depth, p95_depth and max_depth (weighted by time),
    busy_share (time with an open request), full_ns (time with limit or more), rate (begins in a second, from the first
    change to the last) and peak_rate (most begins in rate_ns, by the clock). Quantiles are the least depth that so much of
    the time doesn't exceed; they come from the time at each depth, as many rows as a device has depths.
    """
    stretches = in_flight(requests, width)
    at = stretches.groupBy("track_id", "depth").agg(F.sum("dur").alias("ns"), F.min("ts").alias("first"), F.max(F.col("ts") + F.col("dur")).alias("last"))
    times = F.array_sort(F.collect_list(F.struct("depth", "ns")))
    # a queue of some thousands that stays for a month passes 64 bits
    weighted = F.sum(F.col("depth").cast("decimal(19,0)") * F.col("ns").cast("decimal(19,0)"))
    found = at.groupBy("track_id").agg(
        times.alias("times"), F.sum("ns").alias("whole"), weighted.alias("weighted"), F.max("depth").alias("max_depth"),
        F.sum(F.when(F.col("depth") > 0, F.col("ns")).otherwise(0)).alias("busy"), F.sum(F.when(F.col("depth") >= limit, F.col("ns")).otherwise(0)).alias("full_ns"),
    )
    # walking up the depths, the first at which a hundredth of the wanted share of the time is reached
    reached = "aggregate(times, named_struct('ns', 0L, 'depth', CAST(NULL AS BIGINT)), (a, x) -> IF(a.depth IS NULL, named_struct('ns', a.ns + x.ns, 'depth', IF(CAST(a.ns + x.ns AS DECIMAL(19,0)) * 100 >= CAST(whole AS DECIMAL(19,0)) * {p}, x.depth, NULL)), a), a -> a.depth)"
    begins = requests.where("kind = 'B'").groupBy("track_id", F.floor(F.col("ts") / rate_ns)).agg(F.count("*").alias("n"), F.min("device").alias("device"))
    begins = begins.groupBy("track_id").agg(F.sum("n").alias("requests"), F.max("n").alias("peak_rate"), F.min("device").alias("device"))
    joined = begins.join(found, "track_id", "left")
    return joined.select(
        "track_id", "device", "requests", (F.col("weighted").cast("double") / F.col("whole")).alias("mean_depth"), F.expr(reached.format(p=50)).alias("median_depth"), F.expr(reached.format(p=95)).alias("p95_depth"),
        "max_depth", (F.col("busy") / F.col("whole")).alias("busy_share"), "full_ns", (F.col("requests") * 1e9 / F.col("whole")).alias("rate"), "peak_rate",
    )


def call_failures(events: DataFrame) -> DataFrame:
    """System calls that ended: name (number), calls, failures (a negative value), failure_share, and error, the code that
    most failures have (ties: the least), with error_count. Ends without a value count as calls."""
    found = events.where("event = 'sys_exit'").select(F.nullif(F.regexp_extract("message", r"NR (\d+)", 1), F.lit("")).alias("name"), F.nullif(F.regexp_extract("message", r"=\s*(-?\d+)", 1), F.lit("")).try_cast("long").alias("value"))
    each = found.where("name IS NOT NULL").groupBy("name", F.when(F.col("value") < 0, -F.col("value")).alias("error")).agg(F.count("*").alias("n"))
    failed = F.col("error").isNotNull()
    sums = each.groupBy("name").agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failures"), F.max(F.when(failed, F.struct("n", (-F.col("error")).alias("e")))).alias("most"))
    return sums.select("name", "calls", "failures", (F.col("failures") / F.col("calls")).alias("failure_share"), (-F.col("most.e")).alias("error"), F.col("most.n").alias("error_count"))
