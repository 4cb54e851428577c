"""Queries of requests that overlap, queue depths, failing calls, periods and tied times, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .entries import _TEXT, DAY, HOUR, _events, _text
from .entries_api import _ADDRESS, _REPORT
from .functions.store import kept
from .operators import derive, periods, requests
from .plans.scenarios import SCENARIOS
from .plans.statements import Catalog, pack
from .sources import crash as reports
from .sources import samples
from .sources.ftrace import parse_events

# --- changes of a thread at one time ---------------------------------------------------------------------------------

_COARSE = _TEXT.replace("us * 1000 AS ts", f"us * 1000 // {HOUR} * {HOUR} AS ts")
_LATENCY = """SELECT id AS thread_state_id, (id - 2) // 4 AS sched_id, utid, lag_id AS runnable_latency_id, lag_dur AS latency_dur FROM (
SELECT id, utid, state, lag(id) OVER w AS lag_id, lag(dur) OVER w AS lag_dur, lag(state) OVER w AS lag_state FROM sta WINDOW w AS (PARTITION BY utid ORDER BY ts, id % 4, id)) WHERE state = 'Running' AND lag_state IN ('R', 'R+')"""


def _coarse(spark: SparkSession, sf_dir: str) -> derive.Tables:
    """Tables of a trace whose clock has hours only, so that most changes of a thread share a time with others."""
    events = _events(spark, sf_dir).withColumn("ts", F.expr(f"ts div {HOUR} * {HOUR}"))
    return derive.trace_tables(kept(events, "events"), width=DAY)


@_text("v3_tied_times", f"WITH {_COARSE} {_LATENCY}")
def v3_tied_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir)["sched_latency_for_running_interval"]


@_text("s04_tied_times", f"WITH {_COARSE}, lat AS ({_LATENCY}) SELECT name, avg_latency, max_latency FROM (SELECT utid, name, CAST(sum(latency_dur) AS DOUBLE) / count(latency_dur) AS avg_latency, max(latency_dur) AS max_latency FROM lat JOIN thr USING (utid) GROUP BY utid, name) ORDER BY max_latency DESC NULLS LAST, name, utid LIMIT 20")
def s04_tied_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCENARIOS[4].plan(_coarse(spark, sf_dir))


# --- block requests --------------------------------------------------------------------------------------------------

_BLOCK = f"""WITH b AS (SELECT event_id, event_type, (epoch_us(ts) - {samples.EPOCH_US}) * 1000 AS t, user_id % 3 * 16 AS minor, event_id % 50 * 8 AS sector, (1 + (user_id * 37 + event_id) % 11) * 2400000000000 AS lag FROM events),
bg AS (SELECT t AS ts, event_id * 2 AS place, minor, sector, row_number() OVER (PARTITION BY minor, sector ORDER BY t, event_id) AS n FROM b WHERE event_type <> 'error'),
en AS (SELECT t + lag AS ts, event_id * 2 + 1 AS place, minor, sector, row_number() OVER (PARTITION BY minor, sector ORDER BY t + lag, event_id) AS n FROM b WHERE event_type NOT IN ('signup', 'error')),
rq AS (SELECT bg.place AS id, bg.ts, en.ts - bg.ts AS dur, (8 * 1048576 + bg.minor) * 4 + 2 AS track_id, bg.minor, bg.sector FROM bg LEFT JOIN en ON bg.minor = en.minor AND bg.sector = en.sector AND bg.n = en.n),
st AS (SELECT ts, place, minor, 1 AS step FROM bg UNION ALL SELECT ts, place, minor, -1 FROM en),
dp AS (SELECT minor, ts, lead(ts) OVER w - ts AS dur, sum(step) OVER (PARTITION BY minor ORDER BY ts, place) AS depth FROM st WINDOW w AS (PARTITION BY minor ORDER BY ts, place)),
fl AS (SELECT minor, ts, dur, CAST(depth AS BIGINT) AS depth FROM dp WHERE dur > 0)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.block_requests(kept(parse_events(samples.block_lines(spark, sf_dir)), "events"))


@_text("v4_block_requests", f"{_BLOCK} SELECT id, ts, dur, track_id, 'block_rq_issue' AS name, 'block_io' AS category, CAST(0 AS BIGINT) AS depth FROM rq")
def v4_block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = kept(parse_events(samples.block_lines(spark, sf_dir)), "events")
    return derive.trace_tables(events, width=DAY)["slice"].select("id", "ts", "dur", "track_id", "name", "category", "depth")


@_text("v4_block_tracks", f"{_BLOCK} SELECT track_id AS id, 'block 8,' || minor AS name, 'block' AS type FROM rq GROUP BY ALL UNION SELECT DISTINCT (8 * 1048576 + minor) * 4 + 2, 'block 8,' || minor, 'block' FROM b")
def v4_block_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = kept(parse_events(samples.block_lines(spark, sf_dir)), "events")
    return derive.trace_tables(events, width=DAY)["track"].select("id", "name", "type")


@_text("s12_overlapping", f"{_BLOCK} SELECT 'block_rq_issue' AS name, CAST(sum(dur) AS DOUBLE) / count(dur) AS avg_latency, max(dur) AS max_latency FROM rq")
def s12_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCENARIOS[12].plan(derive.trace_tables(kept(parse_events(samples.block_lines(spark, sf_dir)), "events"), width=DAY))


@_text("m06_in_flight", f"{_BLOCK} SELECT (8 * 1048576 + minor) * 4 + 2 AS track_id, ts, dur, depth FROM fl")
def m06_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.in_flight(_requests(spark, sf_dir), DAY)


@_text("m06_queue_depth", f"""{_BLOCK}, h AS (SELECT minor, depth, sum(dur) AS ns FROM fl GROUP BY ALL), c AS (SELECT *, sum(ns) OVER (PARTITION BY minor ORDER BY depth) AS upto, sum(ns) OVER (PARTITION BY minor) AS whole FROM h),
q AS (SELECT minor, min(depth) FILTER (upto * 100 >= whole * 50) AS median_depth, min(depth) FILTER (upto * 100 >= whole * 95) AS p95_depth, max(depth) AS max_depth, sum(depth * ns)::DOUBLE / max(whole) AS mean_depth,
  coalesce(sum(ns) FILTER (depth > 0), 0)::DOUBLE / max(whole) AS busy_share, CAST(coalesce(sum(ns) FILTER (depth >= 4), 0) AS BIGINT) AS full_ns, max(whole)::DOUBLE AS whole FROM c GROUP BY minor),
r AS (SELECT minor, count(*) AS n FROM bg GROUP BY minor, ts // {HOUR}), s AS (SELECT minor, CAST(sum(n) AS BIGINT) AS requests, max(n) AS peak_rate FROM r GROUP BY minor)
SELECT (8 * 1048576 + minor) * 4 + 2 AS track_id, '8,' || minor AS device, requests, mean_depth, median_depth, p95_depth, max_depth, busy_share, full_ns, requests * 1e9 / whole AS rate, peak_rate FROM s LEFT JOIN q USING (minor)""")
def m06_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.queue_depth(_requests(spark, sf_dir), DAY, 4, HOUR)


# --- failing calls and periods ---------------------------------------------------------------------------------------


@_text("m07_call_failures", """WITH c AS (SELECT CAST(user_id % 30 AS VARCHAR) AS name, CASE event_type WHEN 'error' THEN 11 + user_id % 2 WHEN 'signup' THEN 4 END AS error FROM events), e AS (SELECT name, error, count(*) AS n FROM c GROUP BY ALL)
SELECT name, CAST(sum(n) AS BIGINT) AS calls, CAST(coalesce(sum(n) FILTER (error IS NOT NULL), 0) AS BIGINT) AS failures, coalesce(sum(n) FILTER (error IS NOT NULL), 0)::DOUBLE / sum(n) AS failure_share, arg_max(error, (n, -error)) FILTER (error IS NOT NULL) AS error, max(n) FILTER (error IS NOT NULL) AS error_count FROM e GROUP BY name""")
def m07_call_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.call_failures(parse_events(samples.call_lines(spark, sf_dir)))


@_text("m08_periods", f"""WITH x AS (SELECT event_id, event_id // 4 AS n, user_id AS u, epoch_us(ts) * 1000 AS ts, event_id % 4 AS kind FROM events),
e AS (SELECT kind AS key, CASE kind WHEN 0 THEN n * 7000000 WHEN 1 THEN n * 10000000 + (u * 37 + event_id * 11) % 601 * 1000 - 300000 WHEN 2 THEN (event_id * 7919 + u * 104729) * 1000003 % 20000000000 ELSE ts - {samples.EPOCH_US} * 1000 END AS ts FROM x WHERE kind <> 1 OR u % 10 <> 3),
g AS (SELECT key, lead(ts) OVER (PARTITION BY key ORDER BY ts) - ts AS gap FROM e), p AS (SELECT key, gap, length(bin(gap)) - 1 AS p FROM g WHERE gap >= 8),
b AS (SELECT key, p * 8 + (gap >> (p - 3)) - 8 AS bin, count(*) AS n, sum(gap) AS total FROM p GROUP BY ALL),
m AS (SELECT a.key, a.bin, a.n AS own, sum(b.n) AS near, sum(b.total) AS total FROM b a JOIN b ON a.key = b.key AND b.bin BETWEEN a.bin - 1 AND a.bin + 1 GROUP BY ALL),
k AS (SELECT key, CAST(total // near AS BIGINT) AS period, row_number() OVER (PARTITION BY key ORDER BY near DESC, own DESC, bin) AS nth FROM m QUALIFY nth <= {periods.CANDIDATES}),
s AS (SELECT key, count(*) AS events, max(ts) AS last FROM e GROUP BY key HAVING count(*) >= 30), w AS (SELECT k.*, s.events, s.last, greatest(1, period // {periods.TOLERANCE}) AS tol FROM k JOIN s USING (key)),
l AS (SELECT e.key, w.nth, e.ts, w.last, w.tol, which, CASE which WHEN 1 THEN period WHEN 2 THEN period * 3 // 4 ELSE period * 5 // 4 END AS lag FROM e JOIN w USING (key), (SELECT unnest([1, 2, 3]) AS which)),
a AS (SELECT *, ts + lag + tol AS at FROM l WHERE ts + lag + tol <= last), d AS (SELECT DISTINCT key, ts FROM e),
h AS (SELECT a.key, a.nth, a.which, d.ts >= a.ts + a.lag - a.tol AS hit FROM a ASOF LEFT JOIN d ON a.key = d.key AND a.at >= d.ts),
c AS (SELECT key, nth, count(*) FILTER (which = 1) AS able, count(*) FILTER (which = 1 AND hit) AS partners, count(*) FILTER (which > 1) AS control, count(*) FILTER (which > 1 AND hit) AS control_hits FROM h GROUP BY key, nth),
f AS (SELECT w.key, period AS period_ns, events, coalesce(partners, 0) AS partners, coalesce(able, 0) AS able, coalesce(control, 0) AS control, coalesce(control_hits, 0) AS control_hits FROM w LEFT JOIN c USING (key, nth)),
o AS (SELECT *, partners::DOUBLE / greatest(able, 1) AS share, control_hits::DOUBLE / greatest(control, 1) AS control_share, (control_hits + 0.5::DOUBLE) / (control + 1) AS r FROM f), z AS (SELECT *, (partners - able * r) / sqrt(greatest(1.0::DOUBLE, able * r * (1 - r))) AS zz FROM o)
SELECT key, period_ns, events, partners, share, control_share, round(zz, 6) AS z, share >= {periods.LEAST_SHARE} AND zz >= {periods.LEAST_Z} AS periodic FROM z""")
def m08_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periods(samples.ticks(spark, sf_dir), "key", 60 * 10**9)
    return found.withColumn("z", F.round("z", 6))


# --- packs of SQL ----------------------------------------------------------------------------------------------------

_PACK = """
SELECT 'nothing;' AS before_the_first;
-- Scenario 10: names by a shell pattern; case counts
-- Analysis Goal: waits
SELECT 1; SELECT name, sum(dur) AS total FROM slice WHERE name GLOB '*r[e]d*' GROUP BY name; -- done
-- Scenario 21: names in either case
INCLUDE PERFETTO MODULE linux.irqs; SELECT name, sum(dur) AS total FROM slice WHERE name LIKE 'RED%' GROUP BY name;
-- Scenario 7: a name beside the thread's key
SELECT t.name, sum(dur) AS total FROM sched s JOIN thread t USING (utid) GROUP BY utid;
"""
_SLICES = "slice AS (SELECT CAST(l_quantity * 1000000 AS BIGINT) AS dur, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


@_text("src5_pack_text", f"""WITH {_SLICES}, sched AS (SELECT user_id AS utid, lead(epoch_us(ts) * 1000) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - epoch_us(ts) * 1000 AS dur FROM events)
SELECT 10 AS number, 'waits' AS goal, name, CAST(sum(dur) AS BIGINT) AS total FROM slice WHERE name LIKE '%red%' GROUP BY name UNION ALL SELECT 21, '', name, CAST(sum(dur) AS BIGINT) FROM slice WHERE name ILIKE 'red%' GROUP BY name
UNION ALL SELECT 7, '', c_name, CAST(sum(dur) AS BIGINT) FROM sched JOIN customer ON utid = c_custkey GROUP BY utid, c_name""")
def src5_pack_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(samples.trace_tables(spark, sf_dir))
    found = [s.plan(catalog).select(F.lit(s.number).alias("number"), F.lit(s.goal).alias("goal"), "name", "total") for s in pack(_PACK) if s.number >= 7]
    return found[0].union(found[1]).union(found[2])


# --- sections within sections ----------------------------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sections(samples.nested_lines(spark, sf_dir))


@_text("c31_open_files", f"""{_REPORT} SELECT report, k AS pid, {_ADDRESS.format(x='k')} AS task, 0 AS fd, {_ADDRESS.format(x='k + 1')} AS file, {_ADDRESS.format(x='k + 2')} AS dentry, {_ADDRESS.format(x='k + 3')} AS inode, 'CHR' AS type, '/dev/pts/' || (k % 5) AS path FROM k
UNION ALL SELECT report, k, {_ADDRESS.format(x='k')}, 17, {_ADDRESS.format(x='k + 4')}, {_ADDRESS.format(x='k + 5')}, {_ADDRESS.format(x='k + 6')}, 'SOCK', NULL FROM k WHERE k % 3 = 0""")
def c31_open_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_files(_nested(spark, sf_dir)).drop("line_no")


@_text("c32_mounts", f"{_REPORT} SELECT report, {_ADDRESS.format(x='k')} AS mount, {_ADDRESS.format(x='k + 9')} AS superblock, CASE WHEN k % 2 = 0 THEN 'ext4' ELSE 'tmpfs' END AS type, '/dev/sd' || (k % 7) AS device, '/mnt/disk ' || k AS directory FROM k")
def c32_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mounts(_nested(spark, sf_dir)).drop("line_no")


@_text("c33_devices", f"{_REPORT} SELECT report, CASE WHEN k % 2 = 0 THEN 'char' ELSE 'block' END AS kind, CAST(k % 250 AS INT) AS major, 'name' || (k % 20) AS name, CASE WHEN k % 5 > 0 THEN {_ADDRESS.format(x='k')} END AS address, CASE WHEN k % 5 > 0 THEN 'some_fops' END AS operations FROM k")
def c33_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.devices(_nested(spark, sf_dir)).drop("line_no")


@_text("c34_run_queues", f"""{_REPORT} SELECT report, CAST(k % 8 AS INT) AS cpu, 'ffff88003fc0000' || (k % 8) AS queue, CASE WHEN k % 3 = 0 THEN 'rt' ELSE 'cfs' END AS kind, CAST(100 + k % 40 AS INT) AS prio, k AS pid, {_ADDRESS.format(x='k')} AS task, 'comm' || (k % 20) AS comm FROM k
UNION ALL SELECT report, CAST(c AS INT), 'ffff88003fc0000' || c, 'current', NULL, 0, 'ffffffff81c10440', 'swapper' FROM n, unnest(range(8)) AS u(c)""")
def c34_run_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_queues(_nested(spark, sf_dir)).drop("line_no")
