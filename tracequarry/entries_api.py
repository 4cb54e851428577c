"""More queries with their SQL: the trace object and its query builder, reports, trace text with interrupts, crash reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .entries import _CPUS, _LEVEL, _TEXT, DAY, HOUR, ORACLE, ST, _events, _tables, _text
from .functions.store import kept, shared_folder
from .operators import analyzer, crash, derive, frequency
from .plans.report import as_csv, as_json, as_table, markdown, run_pack, run_scenario, run_statements
from .plans.rules import concentrated, jumping_times, unbalanced
from .plans.scenarios import SCENARIOS
from .sources import crash as reports
from .sources import samples
from .sources.ftrace import counters, parse_events, parse_switches, read_events, within
from .trace import QueryBuilder, QueryResult, TraceFile

SECOND = 10**9
_ALL = """, al AS (SELECT ts, place, cpu, p AS pid, pc AS task, 'sched_switch' AS event, st AS prev_state, u AS next_pid, uc AS next_comm FROM sw
UNION ALL SELECT ts, place, cpu, p, pc, 'sched_wakeup', NULL, NULL, NULL FROM wk)"""


def _trace(spark: SparkSession, sf_dir: str, indexed: bool = False) -> TraceFile:
    """The sample events as a trace text in the shared folder, with an index if asked for."""
    path = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    samples.trace_lines(spark, sf_dir).select("value").write.text(path)
    trace = TraceFile(spark, path, f"{path}-index" if indexed else None)
    if indexed:
        trace.build_index()
    return trace


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return _rows(spark, [(x,) for x in text.splitlines()], "line string")


# --- trace object ----------------------------------------------------------------------------------------------------

_INFO = "SELECT count(*) AS event_count, min(ts) / 1e9 AS start, max(ts) / 1e9 AS end, (max(ts) / 1e9) - (min(ts) / 1e9) AS duration, string_agg(DISTINCT event, ' ' ORDER BY event) AS event_types, count(DISTINCT cpu) AS cpu_count, count(DISTINCT pid) AS process_count FROM al"


def _info(spark: SparkSession, trace: TraceFile) -> DataFrame:
    x = trace.info()
    t = x["time_range"]
    return _rows(spark, [(x["event_count"], t["start"], t["end"], t["duration"], " ".join(x["event_types"]), x["cpu_count"], x["process_count"])], "event_count long, start double, end double, duration double, event_types string, cpu_count long, process_count long")


@_text("t2_info", f"{_ALL} {_INFO}")
def t2_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(spark, _trace(spark, sf_dir))


@_text("src7_info_of_index", f"{_ALL} {_INFO}")
def src7_info_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(spark, _trace(spark, sf_dir, True))


@_text("src8_index", f"SELECT ts // {60 * SECOND} AS ts_part, count(*) AS events FROM (SELECT ts FROM sw UNION ALL SELECT ts FROM wk) WHERE ts BETWEEN {DAY} AND {3 * DAY} GROUP BY 1")
def src8_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _trace(spark, sf_dir, True)
    return read_events(spark, trace.index, DAY, 3 * DAY).groupBy(F.expr(f"ts div {60 * SECOND}").alias("ts_part")).agg(F.count("*").alias("events"))


@_text("t3_summary", f"""{_ALL} SELECT 'event_count: ' || count(*) AS line FROM al UNION ALL SELECT 'cpu_count: ' || count(DISTINCT cpu) FROM al UNION ALL SELECT 'process_count: ' || count(DISTINCT pid) FROM al
UNION ALL SELECT 'event_types: [' || string_agg(DISTINCT '''' || event || '''', ', ' ORDER BY '''' || event || '''') || ']' FROM al""")
def t3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, _trace(spark, sf_dir).summary()).where("line RLIKE '^(event_count|cpu_count|process_count|event_types):'")


@_text("t4_time_range", "SELECT min(ts) / 1e9 AS start, max(ts) / 1e9 AS end, (max(ts) / 1e9) - (min(ts) / 1e9) AS duration FROM sw")
def t4_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = _trace(spark, sf_dir)
    return _rows(spark, [(*trace.get_time_range(), trace.get_duration())], "start double, end double, duration double")


@_text("t5_event_count", f"{_ALL} SELECT count(*) AS events FROM al")
def t5_event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(_trace(spark, sf_dir).get_event_count(),)], "events long")


@_text("t6_cpus", "SELECT DISTINCT CAST(cpu AS BIGINT) AS cpu FROM sw")
def t6_cpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(c,) for c in _trace(spark, sf_dir).get_cpus()], "cpu long")


@_text("t7_processes", "SELECT CAST(tid AS BIGINT) AS pid, name AS comm, kind AS type FROM knd")
def t7_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).processes()


@_text("t8_process_types", "SELECT kind AS type, count(*) AS threads, count(DISTINCT name) AS names FROM knd GROUP BY kind")
def t8_process_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).process_types()


@_text("t9_query", f"{_ALL} SELECT event, count(*) AS count FROM al GROUP BY event")
def t9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir, True).query().group_by("event_type").frame.withColumnRenamed("event_type", "event")


# --- query builder and results ---------------------------------------------------------------------------------------


@_text("q01_time_range", f"{_ALL} SELECT ts, CAST(cpu AS INT) AS cpu, event, task FROM al WHERE ts BETWEEN {5 * DAY} AND {6 * DAY}")
def q01_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir, True).query().time_range(5 * 86400.0, 6 * 86400.0).frame.select("ts", "cpu", "event", "task")


@_text("q03_around_time", f"{_ALL} SELECT ts, CAST(cpu AS INT) AS cpu, event FROM al WHERE ts BETWEEN {10 * DAY - 6 * HOUR} AND {10 * DAY + 6 * HOUR}")
def q03_around_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).around_time(10 * 86400.0, 6 * 3600.0).frame.select("ts", "cpu", "event")


@_text("q07_process_type", f"{_ALL} SELECT task, event, count(*) AS count FROM al WHERE pid <> 0 AND (task LIKE 'kworker%' OR task LIKE 'irq/%') GROUP BY ALL")
def q07_process_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).process_type("kernel_thread", "irq").group_by("task", "event").frame


@_text("q11_order_by", f"{_ALL} SELECT ts, next_pid, event FROM al ORDER BY next_pid DESC NULLS LAST, place LIMIT 60")
def q11_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).order_by("next_pid", False).limit(60).frame.select("ts", "next_pid", "event")


@_text("q12_limit", f"{_ALL} SELECT ts, CAST(cpu AS INT) AS cpu, event FROM al ORDER BY ts, place LIMIT 25")
def q12_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).limit(25).frame.select("ts", "cpu", "event")


@_text("q13_execute", f"{_ALL} SELECT ts, task, next_comm FROM al WHERE task = 'qemu-kvm' OR next_comm = 'qemu-kvm'")
def q13_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).comm("qemu-kvm").execute().frame.select("ts", "task", "next_comm")


@_text("q14_count", "SELECT count(*) AS count FROM sw WHERE st = 'D' AND cpu = 4")
def q14_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(QueryBuilder(_events(spark, sf_dir)).prev_state("D").cpu(4).count(),)], "count long")


@_text("q15_first", f"{_ALL} (SELECT 'by time' AS kind, ts, place FROM al ORDER BY ts, place LIMIT 5) UNION ALL (SELECT 'last first', ts, place FROM al ORDER BY ts DESC, place LIMIT 5)")
def q15_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = QueryBuilder(kept(_events(spark, sf_dir), "events"))
    found = [("by time", r.ts, r.place) for r in query.first(5)] + [("last first", r.ts, r.place) for r in query.order_by("timestamp", False).first(5)]
    return _rows(spark, found, "kind string, ts long, place long")


@_text("q16_to_dataframe", f"{_ALL} SELECT ts, event, task FROM al WHERE cpu = 3 AND ts < {6 * DAY}")
def q16_to_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryBuilder(_events(spark, sf_dir)).cpu(3).time_range(0, 6 * 86400 - 1e-6).execute().shown().select("ts", "event", "task")


@_text("q17_container", f"{_ALL}, r AS (SELECT ts, place FROM al WHERE cpu = 1) SELECT (SELECT count(*) FROM r) AS n, (SELECT ts FROM r ORDER BY ts, place LIMIT 1 OFFSET 7) AS eighth, (SELECT ts FROM r ORDER BY ts DESC, place DESC LIMIT 1) AS last, (SELECT CAST(sum(ts // 1000000) AS BIGINT) FROM r) AS total")
def q17_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = QueryBuilder(kept(_events(spark, sf_dir), "events")).cpu(1).execute()
    picked = _rows(spark, [(len(result), result[7].ts, result[-1].ts)], "n long, eighth long, last long")
    return picked.join(result.frame.agg(F.sum(F.expr("ts div 1000000")).alias("total")))


_STATS = "SELECT 'events' AS kind, CAST(count(*) AS VARCHAR) AS value FROM al UNION ALL SELECT 'processes', CAST(count(DISTINCT pid) AS VARCHAR) FROM al UNION ALL SELECT 'cpus', string_agg(DISTINCT cpu::VARCHAR, ' ' ORDER BY cpu::VARCHAR) FROM al UNION ALL SELECT prev_state, CAST(count(*) AS VARCHAR) FROM al WHERE prev_state IS NOT NULL GROUP BY prev_state"


@_text("q18_summary", f"{_ALL} {_STATS}")
def q18_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = QueryResult(_events(spark, sf_dir)).summary()
    return _rows(spark, [("events", str(x["count"])), ("processes", str(x["processes"])), ("cpus", " ".join(map(str, x["cpus"]))), *((k, str(v)) for k, v in x["state_distribution"].items())], "kind string, value string")


@_text("q19_describe", f"{_ALL} SELECT 'count: ' || count(*) AS line FROM al UNION ALL SELECT 'processes: ' || count(DISTINCT pid) FROM al")
def q19_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, QueryResult(_events(spark, sf_dir)).describe()).where("line RLIKE '^(count|processes):'")


for _name, _field, _where in (("q20_by_cpu", "cpu", "TRUE"), ("q21_by_process", "pid", "TRUE"), ("q22_by_state", "prev_state", "TRUE")):

    @_text(_name, f"{_ALL} SELECT CAST({_field} AS VARCHAR) AS key, count(*) AS n, min(ts) AS first, max(ts) AS last FROM al WHERE ts < {4 * DAY} GROUP BY {_field}")
    def _groups(spark: SparkSession, sf_dir: str, name: str = _name[4:]) -> DataFrame:
        found = getattr(QueryBuilder(_events(spark, sf_dir)).time_range(0, 4 * 86400 - 1e-6).execute(), name)()
        return found.table().select(F.col(found.field).cast("string").alias("key"), F.col("count").alias("n"), F.col("first_ts").alias("first"), F.col("last_ts").alias("last"))


@_text("q23_filter", f"{_ALL} SELECT CAST(cpu AS INT) AS cpu, count(*) AS count FROM al WHERE pid % 2 = 1 AND event = 'sched_switch' GROUP BY cpu")
def q23_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = QueryResult(_events(spark, sf_dir).select("cpu", "pid", "event")).filter(F.col("event") == "sched_switch").filter(lambda r: r.pid % 2 == 1)
    return found.frame.groupBy("cpu").agg(F.count("*").alias("count"))


@_text("a8_qos", f"""{_ALL}, g AS (SELECT cpu, t - lag(t) OVER (PARTITION BY cpu ORDER BY ts, place) AS gap FROM (SELECT *, ts // 350000 AS t FROM al)),
x AS (SELECT CAST(cpu AS INT) AS cpu, count(*) AS gaps, avg(gap) AS avg_ns, stddev_pop(gap) AS sd_ns FROM g WHERE gap BETWEEN 4000000 AND 10000000 GROUP BY cpu)
SELECT cpu, gaps, round(avg_ns, 3) AS avg_ns, round(sd_ns, 3) AS sd_ns, CASE WHEN gaps >= 5 AND sd_ns < 0.2 * avg_ns THEN 'high' WHEN gaps >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def a8_qos(spark: SparkSession, sf_dir: str) -> DataFrame:
    fast = _events(spark, sf_dir).withColumn("ts", F.expr("ts div 350000"))
    return analyzer.qos_gaps(fast, DAY // 350000).select("cpu", "gaps", F.round("avg_ns", 3).alias("avg_ns"), F.round("sd_ns", 3).alias("sd_ns"), "confidence")


@_text("a2_hotspots", ORACLE["a2_time_distribution"].replace(f"WITH {_TEXT}", "").rstrip().replace("SELECT bin, (SELECT min(ts)", ", bi AS (SELECT bin, (SELECT min(ts)", 1) + f"""), hi AS (SELECT *, bin - row_number() OVER (ORDER BY bin) AS island FROM bi WHERE cpu_util > 0.95)
SELECT min(bin_start) AS start, max(bin_start) + {HOUR} AS end, round(avg(cpu_util), 9) AS util FROM hi GROUP BY island""")
def a2_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    found = analyzer.time_distribution(kept(t["sched"], "sched"), kept(t["thread"], "thread"), HOUR)
    return analyzer.hotspots(found, HOUR, 0.95, 1000).select("start", "end", F.round("util", 9).alias("util"))


@_text("a7_gap_processes", f""", o AS (SELECT ts + dur AS gap_start, lead(ts) OVER (ORDER BY ts, id) AS gap_end, cpu FROM schd JOIN thr USING (utid) WHERE tid = 9)
SELECT gap_start, gap_end, o.cpu, string_agg(DISTINCT thr.name, ' ' ORDER BY thr.name) AS processes FROM o JOIN schd r ON r.cpu = o.cpu AND r.ts < gap_end AND r.ts + r.dur > gap_start JOIN thr ON r.utid = thr.utid WHERE gap_end - gap_start > {HOUR} GROUP BY ALL""")
def a7_gap_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    sched, thread = kept(t["sched"], "sched"), kept(t["thread"], "thread")
    found = analyzer.gap_processes(analyzer.thread_gaps(sched, thread, 9, HOUR, DAY), sched, thread, DAY)
    return found.withColumn("processes", F.array_join("processes", " "))


# --- interrupts, system calls, block requests and counters in a trace text -------------------------------------------

_IRQ = f"WITH b AS (SELECT event_id, user_id AS u, event_type, (epoch_us(ts) - {samples.EPOCH_US}) * 1000 AS ts, (1 + user_id % 7) * 1000 AS dur, user_id % 8 AS cpu FROM events)"
_HARD, _SOFT = "(SELECT ts, dur, 'dev' || (u % 9) AS name FROM b WHERE event_type = 'click')", "(SELECT ts, dur, 'NET' || (u % 5) AS name FROM b WHERE event_type = 'view')"
_CALL, _BLOCK = "(SELECT ts, dur, CAST(u % 30 AS VARCHAR) AS name FROM b WHERE event_type = 'purchase')", "(SELECT ts, dur, 'block_rq_issue' AS name FROM b WHERE event_type = 'error')"
_AVG = "CAST(sum(dur) AS DOUBLE) / count(dur) AS {a}"


def _interrupts(spark: SparkSession, sf_dir: str) -> derive.Tables:
    return derive.trace_tables(kept(parse_events(samples.interrupt_lines(spark, sf_dir)), "events"), ("cpu_frequency",), DAY)


for _name, _table, _rows_of in (("v5_hard_irqs", "linux_hard_irqs", _HARD), ("v5_soft_irqs", "linux_soft_irqs", _SOFT)):

    @_text(_name, f"{_IRQ} SELECT * FROM {_rows_of}")
    def _irqs(spark: SparkSession, sf_dir: str, table: str = _table) -> DataFrame:
        return _interrupts(spark, sf_dir)[table].select("ts", "dur", "name")


@_text("v4_text_slices", f"{_IRQ} SELECT ts, dur, name, category, CAST(0 AS BIGINT) AS depth FROM (SELECT *, 'irq' AS category FROM {_HARD} UNION ALL SELECT *, 'softirq' FROM {_SOFT} UNION ALL SELECT *, 'syscall' FROM {_CALL} UNION ALL SELECT *, 'block_io' FROM {_BLOCK})")
def v4_text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interrupts(spark, sf_dir)["slice"].select("ts", "dur", "name", "category", "depth")


@_text("v7_counters", f"{_IRQ} SELECT ts, CAST(u * 1000 AS DOUBLE) AS value, 'cpu_frequency' AS name, 'cpu_counter' AS type FROM b WHERE event_type = 'signup'")
def v7_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _interrupts(spark, sf_dir)
    return t["counter"].join(t["counter_track"].select(F.col("id").alias("track_id"), "name", "type"), "track_id").select("ts", "value", "name", "type")


def _scenario(number: int, sql: str, tables=_interrupts, **parameters) -> None:
    name = f"s{number:02d}_from_text"

    @_text(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return SCENARIOS[number].plan(tables(spark, sf_dir), **parameters)


_scenario(5, f"{_IRQ} SELECT name, count(*) AS count, CAST(sum(dur) AS BIGINT) AS total_dur, {_AVG.format(a='avg_dur')} FROM {_HARD} GROUP BY name")
_scenario(6, f"{_IRQ} SELECT name, CAST(sum(dur) AS BIGINT) AS total_dur, {_AVG.format(a='avg_dur')} FROM {_SOFT} GROUP BY name")
_scenario(12, f"{_IRQ} SELECT name, {_AVG.format(a='avg_latency')}, max(dur) AS max_latency FROM {_BLOCK} GROUP BY name")
_scenario(13, f"{_IRQ} SELECT name, {_AVG.format(a='avg_dur')}, max(dur) AS max_dur, count(*) AS call_count FROM {_CALL} GROUP BY name ORDER BY avg_dur DESC, name LIMIT 20")
_scenario(15, f"{_IRQ} SELECT 'cpu_irq ' || cpu AS track_name, count(*) AS irq_count FROM b WHERE event_type = 'click' GROUP BY cpu")
_LATENCY = ORACLE["v3_sched_latency"].replace(f"WITH {_TEXT}", "")
_LAT = f", lat AS ({_LATENCY})"
_scenario(4, f"{_LAT} SELECT name, avg_latency, max_latency FROM (SELECT utid, name, CAST(sum(latency_dur) AS DOUBLE) / count(latency_dur) AS avg_latency, max(latency_dur) AS max_latency FROM lat JOIN thr USING (utid) GROUP BY utid, name) ORDER BY max_latency DESC NULLS LAST, name, utid LIMIT 20", _tables)
_scenario(19, f"""{_LAT} SELECT thread_name, latency_count_total, count_5ms_10ms, count_over_10ms, max_latency, avg_latency FROM (SELECT utid, name AS thread_name, count(*) AS latency_count_total, count(*) FILTER (latency_dur <= {20 * HOUR}) AS count_5ms_10ms, count(*) FILTER (latency_dur > {20 * HOUR}) AS count_over_10ms,
max(latency_dur) AS max_latency, CAST(sum(latency_dur) AS DOUBLE) / count(latency_dur) AS avg_latency FROM lat JOIN thr USING (utid) WHERE latency_dur > {HOUR} GROUP BY utid, name) ORDER BY count_5ms_10ms DESC, thread_name, utid LIMIT 20""", _tables, low=HOUR, high=20 * HOUR)


@_text("m03_time_jumps", f"WITH x AS (SELECT o_orderkey AS place, o_custkey % 8 AS cpu, epoch_us(o_orderdate) * 1000 AS ts FROM orders), y AS (SELECT *, lag(ts) OVER (PARTITION BY cpu ORDER BY place) AS ts_before FROM x) SELECT cpu, place, ts, ts_before FROM y WHERE ts - ts_before >= {1000 * DAY}")
def m03_time_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey place", "o_custkey % 8 cpu", "unix_micros(CAST(o_orderdate AS timestamp)) * 1000 ts")
    return jumping_times(orders, 1000 * DAY, width=1000)


@_text("m04_concentrated", f"{_IRQ} SELECT 'cpu_irq ' || cpu AS track_name, count(*) AS irq_count, count(*)::DOUBLE / (SELECT count(*) FROM b WHERE event_type = 'click') AS share, count(*)::DOUBLE / (SELECT count(*) FROM b WHERE event_type = 'click') > 0.5 AS concentrated FROM b WHERE event_type = 'click' GROUP BY cpu")
def m04_concentrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentrated(SCENARIOS[15].plan(_interrupts(spark, sf_dir)))


@_text("m05_unbalanced", "WITH x AS (SELECT o_custkey % 20 AS cpu, 5.0 * (o_custkey % 20) AS cpu_usage_percent FROM orders GROUP BY 1, 2) SELECT count(*) FILTER (cpu_usage_percent > 90) AS busy_cpus, count(*) FILTER (cpu_usage_percent < 10) AS idle_cpus, count(*) FILTER (cpu_usage_percent > 90) > 0 AND count(*) FILTER (cpu_usage_percent < 10) > 0 AS unbalanced FROM x")
def m05_unbalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unbalanced(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 20 cpu", "5.0D * (o_custkey % 20) cpu_usage_percent").distinct())


# --- sinks, packs and SQL of one's own -------------------------------------------------------------------------------

_DEPTHS = "SELECT CAST(l_linenumber AS BIGINT) AS depth, count(*) AS count FROM lineitem GROUP BY 1"


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SCENARIOS[26].plan(samples.trace_tables(spark, sf_dir)).orderBy("depth")


@_text("snk2_markdown", f"WITH d AS ({_DEPTHS}) SELECT '| ' || depth || ' | ' || count || ' |' AS line FROM d UNION ALL SELECT 'Found ' || count(*) || ' rows.' FROM d UNION ALL SELECT '## 26. ' || 'Stack depth'")
def snk2_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = markdown([run_scenario(SCENARIOS[26], samples.trace_tables(spark, sf_dir))], "trace")
    return _lines(spark, text).where(r"line RLIKE '^(\\| \\d|Found|## )'")


@_text("snk3_table", f"WITH d AS ({_DEPTHS}) SELECT depth || ' ' || count AS line FROM d UNION ALL SELECT 'Total rows: ' || count(*) FROM d")
def snk3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, as_table(_depths(spark, sf_dir))).where(r"line RLIKE '^(\\d|Total)'").select(F.regexp_replace("line", r"^(\d+) +", "$1 ").alias("line"))


@_text("snk4_csv", f"WITH d AS ({_DEPTHS}) SELECT depth || ',' || count AS line FROM d UNION ALL SELECT 'depth,count'")
def snk4_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, as_csv(_depths(spark, sf_dir)))


@_text("snk5_json", _DEPTHS.replace("SELECT", "WITH x AS (SELECT 1) SELECT", 1))
def snk5_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(r["depth"], r["count"]) for r in json.loads(as_json(_depths(spark, sf_dir)))], "depth long, count long")


@_text("snk6_first_rows", f"WITH d AS ({_DEPTHS}) (SELECT depth || ' ' || count AS line FROM d ORDER BY depth LIMIT 3) UNION ALL SELECT (count(*) - 3) || ' more rows are not shown.' FROM d UNION ALL SELECT 'Total rows: ' || count(*) FROM d")
def snk6_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, as_table(_depths(spark, sf_dir), 3)).where(r"line RLIKE '^(\\d|Total)'").select(F.regexp_replace("line", r"^(\d+) +(\d)", "$1 $2").alias("line"))


@_text("snk7_text", f"SELECT concat('sched_switch: prev_comm=', pc, ' prev_pid=', p, ' prev_prio=120 prev_state=', st, ' ==> next_comm=', uc, ' next_pid=', u, ' next_prio=', prio) AS line FROM sw WHERE cpu = 2 AND ts < {6 * DAY}")
def snk7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QueryResult(within(_events(spark, sf_dir), None, 6 * DAY - 1).where("cpu = 2 AND event = 'sched_switch'")).lines("raw")


_TOP_NAMES = " UNION ALL ".join(f"SELECT 'comm=' || comm || ', count=' || count || ', percent=' || printf('%.2f', percent) FROM ({ORACLE[q].replace(f'WITH {_TEXT}', '')})" for q in ("r01_next_comm", "r02_prev_comm"))
_SUMMED = "total_events={}, blocked_names={}, virtualisation_names={}, most_active={}, most_active_count={}, busiest_cpu={}, busiest_cpu_count={}"


@_text("snk9_report", f"""SELECT 'cpu=' || cpu || ', count=' || count || ', percent=' || printf('%.2f', percent) || ', level=' || {_LEVEL} AS line FROM ({_CPUS.replace('GROUP BY ALL', 'GROUP BY 1')})
UNION ALL SELECT '[' || s || ']' FROM unnest(['next_comm', 'prev_comm', 'virtualisation', 'cpu', 'blocked', 'states', 'summary']) t(s)
UNION ALL {_TOP_NAMES}
UNION ALL SELECT 'comm=' || comm || ', count=' || count FROM ({ORACLE['r03_virtualisation'].replace(f'WITH {_TEXT}', '')})
UNION ALL SELECT 'comm=' || comm || ', count=' || count || ', share=' || printf('%.2f', share) || ', verdict=' || verdict FROM ({ORACLE['r06_blocked'].replace(f'WITH {_TEXT}', '')})
UNION ALL SELECT 'state=' || state || ', count=' || count || ', percent=' || printf('%.2f', percent) || ', description=' || description FROM ({ORACLE['r07_states'].replace(f'WITH {_TEXT}', '')})
UNION ALL SELECT format('{_SUMMED}', total_events, blocked_names, virtualisation_names, most_active, most_active_count, busiest_cpu, busiest_cpu_count) FROM ({ORACLE['r08_summary'].replace(f'WITH {_TEXT}', '')})""")
def snk9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\n".join(frequency.report_lines(kept(parse_switches(samples.trace_lines(spark, sf_dir)), "switches")))
    return _lines(spark, text).where("line <> ''")


@_text("src4_catalog", "SELECT name, count(*) AS runs, CAST(sum(dur) AS BIGINT) AS used FROM schd JOIN thr USING (utid) GROUP BY name")
def src4_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_statements(_tables(spark, sf_dir), "SELECT name, count(*) AS runs, sum(dur) AS used FROM sched JOIN thread USING (utid) GROUP BY name")[0]


@_text("src5_pack", "SELECT 1 AS number, count(DISTINCT cpu) AS found, false AS failed FROM sw UNION ALL SELECT 2, count(DISTINCT cpu), false FROM sw UNION ALL SELECT 24, 1, false UNION ALL SELECT 25, 0, true UNION ALL SELECT 29, 1, false")
def src5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_pack({"sched": kept(_tables(spark, sf_dir)["sched"], "sched")}, (1, 2, 24, 25, 29))
    return _rows(spark, [(r.scenario.number, r.total, bool(r.error)) for r in found], "number int, found long, failed boolean")


@_text("src6_statements", "SELECT 1 AS statement, count(*) AS n FROM schd UNION ALL SELECT 2, count(*) FROM thr WHERE name LIKE 'kworker%'")
def src6_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "INCLUDE PERFETTO MODULE x;\n-- all runs\nSELECT 1 AS statement, count(*) AS n FROM sched;\nSELECT 2 AS statement, count(*) AS n\nFROM thread WHERE name LIKE 'kworker%';\n"
    first, second = run_statements(_tables(spark, sf_dir), sql)
    return first.union(second)


@_text("r11_counters", "SELECT (SELECT count(*) FROM sw) + (SELECT count(*) FROM wk) + c.n AS lines, (SELECT count(*) FROM sw) + (SELECT count(*) FROM wk) AS events, (SELECT count(*) FROM sw) AS switches, c.n AS skipped FROM (SELECT count(*) AS n FROM events WHERE event_id % 50 = 0) c")
def r11_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(samples.trace_lines(spark, sf_dir))


# --- crash reports ---------------------------------------------------------------------------------------------------

_REPORT = "WITH RECURSIVE k AS (SELECT c_custkey AS k, 'r' || c_nationkey AS report FROM customer), n AS (SELECT n_nationkey AS n, 'r' || n_nationkey AS report FROM nation)"
_ADDRESS = "'ffff8800' || printf('%08x', {x})"


def _report(spark: SparkSession, sf_dir: str, *sections: str) -> DataFrame:
    """The sample reports, or the lines of some of their sections."""
    found = samples.report_lines(spark, sf_dir)
    return reports.sections(found).where(F.col("section").isin(*sections)) if sections else found


@_text("c02_blocked_tasks", f"{_REPORT} SELECT report, k AS pid, {_ADDRESS.format(x='k')} AS task, 'comm' || (k % 20) AS comm FROM k WHERE k % 3 = 0")
def c02_blocked_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.in_state(reports.ps(_report(spark, sf_dir, "ps")), "UN").select("report", "pid", "task", "comm")


@_text("c03_largest", f"{_REPORT} SELECT report, k AS pid, k * 7 % 1000 AS rss FROM k ORDER BY rss DESC, report, pid LIMIT 15")
def c03_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.largest(reports.ps(_report(spark, sf_dir, "ps")), "rss", 15, "report", "pid").select("report", "pid", "rss")


_SLAB = "(SELECT report, 'cache' || k AS cache, k % 5 * 100 AS objs, k % 5 * 100 - k % 2 * k % 5 AS active, k % 5 * 100 AS total, 64 + k % 3 AS size FROM k)"


@_text("c04_non_empty_caches", f"{_REPORT} SELECT * FROM {_SLAB} WHERE objs > 0")
def c04_non_empty_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.non_empty(reports.slab(_report(spark, sf_dir, "kmem -s"))).drop("line_no")


@_text("c12_leak_time", f"{_REPORT} SELECT report, cache, total, total * size AS bytes, total / 30.0::DOUBLE AS seconds, size * 86400.0::DOUBLE * 30 AS bytes_per_day FROM {_SLAB} WHERE active = total AND total > 0")
def c12_leak_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.leak_time(reports.slab(_report(spark, sf_dir, "kmem -s")), 30)


_CLASSES = "CASE k % 6 WHEN 0 THEN 'soft_lockup' WHEN 1 THEN 'out_of_memory' WHEN 2 THEN 'blocked_task' WHEN 3 THEN 'filesystem' END"


@_text("c08_signatures", f"{_REPORT}, s AS (SELECT report, {3 * 10**7 + 1} + k AS line_no, {_CLASSES} AS class FROM k WHERE k % 6 < 4) SELECT report, line_no, class, line_no = min(line_no) OVER (PARTITION BY report) AS is_first FROM s")
def c08_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.signatures(_report(spark, sf_dir)).drop("text")


@_text("c10_callers", f"{_REPORT} SELECT unnest(['schedule', 'mutex_lock']) AS func, count(*) AS stacks FROM k WHERE k % 4 = 0 GROUP BY 1")
def c10_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.callers(reports.frames(_report(spark, sf_dir)), "^mutex_lock$")


@_text("c13_cause_of_dump", f"{_REPORT} SELECT report, 'manual' AS cause, count(*) AS lines FROM k WHERE k % 6 = 5 GROUP BY report UNION ALL SELECT report, 'fault', 1 FROM n")
def c13_cause_of_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("report", crash.cause_of_dump().alias("cause")).agg(F.count("*").alias("lines")).where("cause IS NOT NULL")


_PHASES = "SELECT n.report, CASE WHEN bool_or(k % 6 = 1) THEN 'memory' WHEN bool_or(k % 6 = 2) THEN 'lock' WHEN bool_or(k % 6 = 0) THEN 'interrupt' WHEN bool_or(k % 6 = 3) THEN 'filesystem' WHEN bool_or(k % 6 = 4) THEN 'driver' ELSE 'unknown' END AS phase FROM n LEFT JOIN k USING (report) GROUP BY n.report"


@_text("c14_phase", f"{_REPORT} {_PHASES}")
def c14_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.phase(_report(spark, sf_dir))


@_text("c15_commands", f"{_REPORT}, p AS ({_PHASES}), c AS (SELECT unnest([{', '.join(repr(s) for s, _ in crash.COMMANDS)}]) AS symptom, unnest([{', '.join(repr(c) for _, c in crash.COMMANDS)}]) AS command) SELECT report, phase, command FROM p JOIN c ON symptom = CASE phase WHEN 'memory' THEN 'memory' WHEN 'lock' THEN 'hang' ELSE 'slow' END")
def c15_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.commands(crash.phase(_report(spark, sf_dir)))


@_text("c17_sections", f"""{_REPORT}, s AS (SELECT report, unnest(['sys', 'ps', 'kmem -s', 'log', 'foreach bt', 'irq', 'timer', 'mod', 'kmem -i']) AS section, unnest([3, 1, 1, 1, 1, 2, 1, 2, 2]) AS lines FROM n
UNION ALL SELECT report, unnest(['ps', 'kmem -s', 'log', 'foreach bt', 'timer', 'waitq', 'struct mutex']), unnest([1, 1, 1, 3, 1, 2, 2]) FROM k) SELECT report, section, CAST(sum(lines) AS BIGINT) AS lines FROM s GROUP BY ALL""")
def c17_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = reports.sections(_report(spark, sf_dir)).withColumn("section", F.regexp_replace("section", " [0-9a-f]{16}$", ""))
    return named.groupBy("report", "section").agg(F.count("*").alias("lines"))


@_text("c18_poison", f"{_REPORT} SELECT report, 'use_after_free' AS poison, count(*) AS lines FROM k WHERE k % 6 = 5 GROUP BY report")
def c18_poison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("report", crash.poison().alias("poison")).agg(F.count("*").alias("lines")).where("poison IS NOT NULL")


@_text("c20_ps", f"{_REPORT} SELECT report, {10**7 + 1} + k AS line_no, k AS pid, 1::BIGINT AS ppid, CAST(k % 8 AS INT) AS cpu, {_ADDRESS.format(x='k')} AS task, CASE WHEN k % 3 = 0 THEN 'UN' ELSE 'RU' END AS st, 0.1::DOUBLE AS mem, k * 10 AS vsz, k * 7 % 1000 AS rss, 'comm' || (k % 20) AS comm FROM k")
def c20_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ps(_report(spark, sf_dir, "ps"))


@_text("c21_log", f"{_REPORT} SELECT report, CAST(k || '.' || lpad((k % 1000)::VARCHAR, 6, '0') AS DOUBLE) AS ts_sec, CAST(length(CASE k % 6 WHEN 0 THEN 'BUG: soft lockup - CPU#' || (k % 8) || ' stuck' WHEN 1 THEN 'Out of memory: Kill process ' || k WHEN 2 THEN 'INFO: task t' || k || ' blocked for more than 120 seconds' WHEN 3 THEN 'EXT4-fs error (device sda' || (k % 4) || ')' WHEN 4 THEN 'usb 1-1: firmware ready' ELSE 'fault at 6b6b6b6b6b6b6b6b, kdump: saving' END) AS INT) AS chars FROM k")
def c21_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log(_report(spark, sf_dir, "log")).select("report", F.col("ts_sec").cast("double").alias("ts_sec"), F.length("msg").alias("chars"))


@_text("c22_frames", f"{_REPORT} SELECT report, k AS pid, 0 AS idx, 'schedule' AS func, CAST(NULL AS VARCHAR) AS off FROM k UNION ALL SELECT report, k, 1, CASE WHEN k % 4 = 0 THEN 'mutex_lock' ELSE 'fn' || (k % 7) END, '0x45' FROM k")
def c22_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.frames(_report(spark, sf_dir)).drop("line_no")


@_text("c23_memory", f"{_REPORT} SELECT report, 'TOTAL MEM' AS label, CAST(10 + n AS BIGINT) * 1000000000 AS bytes FROM n")
def c23_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.memory(_report(spark, sf_dir, "kmem -i")).drop("line_no")


@_text("c24_system", f"{_REPORT} SELECT report, 'KERNEL' AS key, 'vmlinux-6' AS value FROM n UNION ALL SELECT report, 'PANIC', '\"Oops: ' || n || '\"' FROM n")
def c24_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.system(_report(spark, sf_dir, "sys")).drop("line_no")


@_text("c25_interrupts", f"{_REPORT} SELECT report, CAST(n AS INT) AS irq, CAST(n * 103 AS BIGINT) AS count, 'IO-APIC-fasteoi' AS handler, 'eth' || n AS device FROM n")
def c25_interrupts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.interrupts(_report(spark, sf_dir, "irq")).drop("line_no")


@_text("c26_timers", f"{_REPORT} SELECT report, 4295000000 + k AS expires, {_ADDRESS.format(x='k')} AS timer, 'timer_fn' || (k % 5) AS func FROM k")
def c26_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timers(_report(spark, sf_dir, "timer")).drop("line_no")


@_text("c27_modules", f"{_REPORT} SELECT report, 'ffffffffa00' || lpad(n::VARCHAR, 5, '0') AS module, 'mod' || n AS name, CAST(4096 + n AS BIGINT) AS size, '(not loaded)' AS file FROM n")
def c27_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.modules(_report(spark, sf_dir, "mod")).drop("line_no")


@_text("c28_wait_edges", f"{_REPORT} SELECT report, {_ADDRESS.format(x='1000000 + k')} AS lock, {_ADDRESS.format(x='k')} AS task, {_ADDRESS.format(x='k * k % 97')} AS owner FROM k")
def c28_wait_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.wait_edges(reports.sections(_report(spark, sf_dir)))


@_text("c29_lock_rings", f"""{_REPORT}, w AS (SELECT report, k AS task, k * k % 97 AS owner FROM k), r AS (SELECT report, task AS src, owner AS cur, 1 AS n, least(task, owner) AS low FROM w UNION ALL SELECT r.report, r.src, w.owner, n + 1, least(low, w.owner) FROM r JOIN w ON r.cur = w.task AND r.report = w.report WHERE r.cur <> r.src AND n < 100)
SELECT report, {_ADDRESS.format(x='src')} AS task, {_ADDRESS.format(x='low')} AS ring, CAST(n AS BIGINT) AS length FROM r WHERE cur = src""")
def c29_lock_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.wait_rings(reports.wait_edges(reports.sections(_report(spark, sf_dir))).select("report", "task", "owner"))


@_text("c30_rings_by_report", """WITH RECURSIVE w AS (SELECT DISTINCT event_type AS report, user_id AS task, (user_id * user_id + length(event_type)) % 150 AS owner FROM events),
r AS (SELECT report, task AS src, owner AS cur, 1 AS n, least(task, owner) AS low FROM w UNION ALL SELECT r.report, r.src, w.owner, n + 1, least(low, w.owner) FROM r JOIN w ON r.cur = w.task AND r.report = w.report WHERE r.cur <> r.src AND n < 151)
SELECT report, src AS task, low AS ring, CAST(n AS BIGINT) AS length FROM r WHERE cur = src""")
def c30_rings_by_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type report", "user_id task").distinct()
    return crash.wait_rings(users.selectExpr("report", "task", "(task * task + length(report)) % 150 owner"))


_QUICK = "SELECT report, CASE k % 6 WHEN 0 THEN 'panic' WHEN 1 THEN 'memory' WHEN 2 THEN 'deadlock' WHEN 3 THEN 'filesystem' WHEN 4 THEN 'driver' END AS pattern FROM k WHERE k % 6 < 5 UNION ALL SELECT report, 'panic' FROM n"


@_text("c06_quick_patterns", f"{_REPORT}, q AS ({_QUICK}) SELECT report, pattern, count(*) AS lines FROM q GROUP BY ALL")
def c06_quick_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crash.quick_patterns(_report(spark, sf_dir))
