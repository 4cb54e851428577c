"""Text parsing, derived tables, the trace API and streaming on small traces with known answers."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.ordered import last_known, neighbour, running_height, running_sums
from tracequarry.functions.text import glob, process_type, size_value
from tracequarry.operators import analyzer, derive, frequency
from tracequarry.plans.report import as_csv, as_json, as_table, markdown, register, run_pack, run_statements, statements
from tracequarry.schemas import TABLES, columns
from tracequarry.sources.ftrace import counters, kernel_log, kernel_log_header, parse_events, parse_switches, read_events, read_lines, write_counted
from tracequarry.streaming.live import active_spells, counts, runs, stream_lines, timed
from tracequarry.trace import Analyzer, QueryResult, TraceFile

ALIGNMENT = [
    "  kworker/u16:0-1234  [000] .... 7541.834000: sched_switch: prev_comm=kworker/u16:0 prev_pid=1234 prev_prio=120 prev_state=S ==> next_comm=swapper/0 next_pid=0 next_prio=120",
    "          swapper-0     [000] .... 7541.835000: sched_switch: prev_comm=swapper/0 prev_pid=0 prev_prio=120 prev_state=R ==> next_comm=kube-apiserver next_pid=3711 next_prio=120",
    "   kube-apiserver-3711  [000] .... 7541.836000: sched_switch: prev_comm=kube-apiserver prev_pid=3711 prev_prio=120 prev_state=S ==> next_comm=swapper/0 next_pid=0 next_prio=120",
]


def throttled():
    """Gaps of 8 ms on CPU 0 and of 1 to 3 ms on CPU 1; the clock starts again for CPU 1 and the last line has no end."""
    lines, us = [], 100_000_000
    for _ in range(10):
        for comm, pid, step in (("task", 1000, 8000), ("swapper/0", 0, 2000)):
            lines.append(f"task-1000 [000] .... {us / 1e6:.6f}: sched_switch: prev_comm={comm} prev_pid={pid} ...")
            us += step
    us = 100_000_000
    for k in range(10):
        lines.append(f"task-2000 [001] .... {us / 1e6:.6f}: sched_switch: ...")
        us += 1000 * (1 + k % 3)
    return lines


@pytest.fixture
def trace(spark, tmp_path):
    def made(lines, **options):
        path = tmp_path / "trace.log"
        path.write_text("\n".join(lines))
        return TraceFile(spark, str(path), **options)

    return made


def lines_of(spark, lines):
    return spark.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "value string, place long")


def test_three_lines(spark, trace):
    t = trace(ALIGNMENT)
    assert [(r.task, r.pid, r.ts) for r in t.events.orderBy("ts").collect()] == [("kworker/u16:0", 1234, 7541834000000), ("swapper", 0, 7541835000000), ("kube-apiserver", 3711, 7541836000000)]
    sched = t.tables["sched"].join(t.tables["thread"].select("utid", "tid"), "utid").orderBy("ts").collect()
    assert [(r.ts, r.dur, r.tid, r.end_state) for r in sched] == [(7541834000000, 1000000, 0, "R"), (7541835000000, 1000000, 3711, "S"), (7541836000000, None, 0, None)]
    results = {r.scenario.number: r for r in run_pack(t.tables)}
    assert [tuple(r) for r in results[1].rows] == [(0, 0.002, 100.0)] and [tuple(r) for r in results[2].rows] == [(0, 3, 1500.0)]
    assert tuple(results[24].rows[0]) == (0.002, 3) and results[29].rows[0][0] == 2
    assert sorted(str(r.gap) for r in results[30].rows) == ["1000000", "1000000", "None"]
    assert not any(r.error for r in results.values()) and [r.scenario.number for r in run_pack(t.tables, (10, 9))] == [9, 10]
    text = markdown(list(results.values()), "trace.log")
    assert "## 1. CPU busy share" in text and "| 0 | 0.002 | 100.0 |" in text and "No data." in text
    broken = run_pack({"sched": t.tables["sched"]}, (3, 24))
    assert broken[0].error and not broken[1].error


def test_three_lines_through_the_api(trace):
    t = trace(ALIGNMENT)
    a = Analyzer(t)
    gaps = a.detect_time_anomalies(100)
    assert gaps["summary"] == {"total_gaps": 2, "max_gap_us": 1000.0, "p95_gap_us": 1000.0} and len(gaps["gaps"]) == 2
    found = a.classify_contexts()
    assert sorted(found) == ["idle", "irq", "kernel_thread", "softirq", "user_process"]
    assert found["user_process"]["time_percent"] == found["idle"]["time_percent"] == 50.0 and found["user_process"]["processes"] == ["kube-apiserver"]
    assert t.info()["time_range"] == {"start": 7541.834, "end": 7541.836, "duration": pytest.approx(0.002)} and t.info()["line_count"] == 3 and t.info()["file_size"].endswith(" B")
    assert {r.comm for r in t.get_processes()} >= {"kube-apiserver", "swapper/0"} and a.check_process_running("kube-apiserver")["run_time"] == 0.001 and not a.check_process_running("nobody")["is_running"]
    run = a.check_process_running(3711)
    assert (run["is_running"], run["run_time"], run["run_percent"], run["sched_count"], run["avg_timeslice_ms"]) == (True, 0.001, 50.0, 1, 1.0)
    assert a.check_process_running(0)["is_running"] and not a.check_process_running(5)["is_running"]
    assert a.check_process_running(3711, (7541.8355, 7541.8358))["run_time"] == pytest.approx(0.0003)
    assert a.compare_cpu_time(3711, 0)[3711] == {"time": 0.001, "percent": 50.0}
    assert [r["context"] for r in a.get_context_timeline(0)] == ["idle", "user_process", "idle"]
    assert a.get_time_distribution(0.001)["cpu_util"] == [0.0, 1.0, 0.0]
    q = t.query()
    assert q.count() == 3 and q.first()[0].pid == 1234 and len(q.to_dataframe()) == 3
    result = q.execute()
    assert result.summary()["processes"] == 3 and result.summary()["state_distribution"] == {"S": 2, "R": 1}
    assert len(result) == 3 and result[1].pid == 0 and [r.pid for r in result] == [1234, 0, 3711]
    with pytest.raises(IndexError):
        result[3]
    assert q.time_range(7541.835, 7541.836).count() == 2 and q.time_slice(0.001).count() == 2 and q.around_time(7541.836, 0.0005).count() == 1
    assert q.cpu(1).count() == 0 and q.pid(3711).count() == 2 and q.comm("swapper").count() == 1 and q.comm(pattern="^kube").count() == 2
    assert q.prev_state("S").event_type("sched_switch").count() == 2 and q.process_type("idle").count() == 1
    assert [tuple(r) for r in q.group_by("cpu").frame.collect()] == [(0, 3)] and q.order_by("ts", False).limit(1).frame.first().pid == 3711
    assert result.filter(F.col("pid") == 0).frame.count() == result.filter(lambda r: r.pid == 0).frame.count() == 1
    assert [r["count"] for r in result.timeline(0.001).orderBy("bin").collect()] == [1, 1, 1]
    assert [len(v) for v in result.by_cpu().values()] == [3] and {k: len(v) for k, v in result.by_state().items()} == {"S": 2, "R": 1} and sorted(result.by_process()) == [0, 1234, 3711]
    assert result.by("cpu").first()["count"] == 3 and result[-1].pid == 3711 and len(list(result.events)) == 3
    assert len(json.loads(result.to_json())) == 3 and "next_comm=swapper/0" in result.to_text("raw") and "Total rows: 3" in result.to_text()
    assert result.to_csv().count("\n") == 4 and "count: 3" in result.describe()


def test_frequency_report(spark):
    found = parse_switches(lines_of(spark, [*ALIGNMENT, "noise without the word"]))
    assert [tuple(r) for r in frequency.frequent(found, "next_comm").collect()] == [("swapper/0", 2, pytest.approx(200 / 3)), ("kube-apiserver", 1, pytest.approx(100 / 3))]
    assert [r.comm for r in frequency.frequent(found, "prev_comm").collect()] == ["kworker/u16:0", "swapper/0", "kube-apiserver"]
    assert frequency.blocked(found).count() == 0 and frequency.virtualisation(found).count() == 0
    assert [(r.cpu, r["count"], r.percent) for r in frequency.by_cpu(found).collect()] == [("000", 3, 100.0)]
    assert [(r.state, r["count"]) for r in frequency.states(found).collect()] == [("S", 2), ("R", 1)]
    assert frequency.summary(found).first().most_active == "swapper/0" and frequency.summary(found.limit(0)).first().total_events == 0
    twice = parse_switches(lines_of(spark, ["sched_switch: prev_comm=qemu-kvm next_comm=qemu-kvm", "sched_switch: prev_comm=a prev_state=R+ next_comm=VHOST-1", "sched_switch: prev_state=t"]))
    assert {r.comm: r["count"] for r in frequency.virtualisation(twice).collect()} == {"qemu-kvm": 4, "VHOST-1": 1}
    assert [r.prev_state for r in twice.orderBy("place").collect()] == [None, "R", None] and frequency.report_lines(twice)


def test_throttling_and_report_of_it(spark, trace):
    t = trace(throttled())
    assert t.events.count() == 30 and t.events.where("prev_comm IS NOT NULL").count() == 20
    found = Analyzer(t).detect_qos_patterns()
    assert found["suspected_qos"] and list(found["details"]) == ["cpu_0"]
    assert found["details"]["cpu_0"] == {"confidence": "high", "gaps": 10, "avg_duration_ms": 8.0}
    switches = parse_switches(read_lines(spark, t.path))
    assert [(r.comm, r["count"]) for r in frequency.frequent(switches, "prev_comm").collect()] == [("task", 10), ("swapper/0", 10)]
    assert frequency.frequent(switches, "next_comm").count() == 0 and frequency.states(switches).count() == 0
    assert [(r.cpu, round(r.percent, 2)) for r in frequency.by_cpu(switches).collect()] == [("000", 66.67), ("001", 33.33)]


def test_kernel_log(spark):
    assert kernel_log_header() == "window=2026-01-09T10:38:15Z-2026-01-09T11:08:15Z start_utc=2026-01-09T10:38:15Z end_utc=2026-01-09T11:08:15Z tag=ftrace_transform"
    rows = [r.value for r in kernel_log(lines_of(spark, ALIGNMENT)).orderBy("place").collect()]
    assert rows[0].startswith("2026-01-09T12:43:56Z ftrace: [CPU 000] kworker/u16:0-1234: sched_switch: prev_comm=")


def test_lines_that_are_no_events(spark, trace):
    odd = ["# comment", "", "  cpu 0 buffer started ...", "  bash-12  (  12) [000] d..2. 1.5: x: y", " a-1 [000] d... 1.2.3: x: y", " a-1 [000] d... 1.5: x: y", " b\x01c-2 [001] d... 2.5: x: y\x01z"]
    assert [(r.task, r.ts, r.event) for r in parse_events(lines_of(spark, odd)).orderBy("ts").collect()] == [("a", 1_500_000_000, "x"), ("b\x01c", 2_500_000_000, "x")]
    assert parse_events(lines_of(spark, odd)).where("task = 'b\x01c'").first().message == "x: y\x01z"
    for lines in ([], ["# only a comment"]):
        t = trace(lines)
        assert t.info()["event_count"] == 0 and t.get_duration() == 0.0 and t.get_cpus() == [] and t.summary()
        assert Analyzer(t).detect_time_anomalies()["gaps"] == [] and Analyzer(t).detect_time_gaps() == [] and not Analyzer(t).detect_qos_patterns()["suspected_qos"]
        assert Analyzer(t).classify_contexts()["user_process"]["count"] == 0 and t.query().execute().timeline().count() == 0


def test_stored_events_are_pruned(spark, trace, tmp_path):
    t = trace([f"a-{k} [00{k % 3}] d... {k * 30}.000001: ping: n={k}" for k in range(40)], index=str(tmp_path / "stored"))
    before = t.info()
    assert not t.has_index()
    t.build_index()
    t.build_index()
    assert t.has_index() and t.info() == before | {"indexed": True}

    def filters(frame):
        return re.findall(r"PartitionFilters: \[([^\]]*)\]", frame._jdf.queryExecution().executedPlan().toString())

    part = read_events(spark, t.index, 100 * 10**9, 200 * 10**9)
    assert part.count() == 3 and "ts_part" in filters(part)[0]
    for query in (t.query().time_range(100, 200), t.query().cpu(0, 1, 2).around_time(150, 50), t.query().time_slice(100, 99.999999)):
        assert query.count() == 3 and "ts_part" in filters(query.frame)[0]
    assert "ts_part" not in t.query().to_dataframe().columns
    later = os.path.getmtime(t.path) + 10
    os.utime(t.path, (later, later))
    assert not t.has_index()


def test_tables_have_their_columns(trace):
    tables = trace(ALIGNMENT).tables
    assert sorted(tables) == sorted(TABLES)
    for name, frame in tables.items():
        assert [(c, t) for c, t in frame.dtypes] == [(c, t.lower()) for c, t in columns(name)]
    register(tables)
    spark = tables["sched"].sparkSession
    assert spark.sql("SELECT count(*) AS n FROM sched JOIN thread USING (utid)").first().n == 3


def test_wake_ups_and_latency(spark):
    switch = lambda t, p, s, n: f" x-1 [000] d... {t}.000000: sched_switch: prev_comm=c{p} prev_pid={p} prev_prio=1 prev_state={s} ==> next_comm=c{n} next_pid={n} next_prio=2"
    wake = lambda t, w: f" w-9 [000] d... {t}.000000: sched_wakeup: comm=c{w} pid={w} prio=1 target_cpu=000"
    events = parse_events(lines_of(spark, [switch(0, 7, "S", 8), wake(5, 7), wake(6, 7), switch(8, 8, "R", 7), wake(9, 7), switch(12, 7, "S", 8)]))
    t = derive.trace_tables(events)
    seven = [(r.ts // 10**9, r.dur and r.dur // 10**9, r.state, r.waker_utid) for r in t["thread_state"].where(f"utid = {7 * 65536}").orderBy("ts").collect()]
    assert seven == [(0, 5, "S", None), (5, 3, "R", 9 * 65536), (8, 4, "Running", None), (12, None, "S", None)]
    assert [(r.utid // 65536, r.latency_dur // 10**9) for r in t["sched_latency_for_running_interval"].orderBy("latency_dur").collect()] == [(7, 3), (8, 4)]
    running = {r.id for r in t["thread_state"].where("state = 'Running'").collect()}
    assert {(r.id * 4 + 2) for r in t["sched"].collect()} == running


def stacked(rows):
    """Slices, self times and parents of begins and ends by a plain stack for each track; rows sorted by time."""
    stacks, slices, own = {}, {}, {}
    last = {}
    for ts, track, kind, place in rows:
        stack = stacks.setdefault(track, [])
        if stack and track in last:
            own[stack[-1]] = own.get(stack[-1], 0) + ts - last[track]
        last[track] = ts
        if kind == "B":
            slices[place] = [ts, None, len(stack), stack[-1] if stack else None]
            stack.append(place)
        elif stack:
            slices[stack[-1]][1] = ts - slices[stack[-1]][0]
            stack.pop()
    return {k: tuple(v) for k, v in slices.items()}, {k: v for k, v in own.items() if v}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nested_slices_against_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = [(ts, rng.randrange(3), rng.choice("BBE" if seed == 2 else "BE"), k) for k, ts in enumerate(sorted(rng.sample(range(2000), 150)))]
    frame = spark.createDataFrame([(*r, "c", f"f{r[3]}") for r in rows], "ts long, track_id long, kind string, place long, category string, name string")
    slices, own = stacked(rows)
    for width in (7, 300, 10**9):
        got = {r.id: (r.ts, r.dur, r.depth, r.parent_id) for r in derive.slices(frame, width).collect()}
        assert got == slices
        flat = derive.flattened(frame, width).groupBy("slice_id").agg(F.sum("dur").alias("d")).collect()
        assert {r.slice_id: r.d for r in flat} == own


@pytest.mark.parametrize("width", [3, 50, 10**6])
def test_ordered_helpers_against_plain_windows(spark, width):
    rng = random.Random(width)
    rows = [(k, rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(200), rng.choice([None, k])) for k in range(300)]
    frame = spark.createDataFrame(rows, "id long, key string, at long, v long")
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(r[1], []).append(r)
    after = {a[0]: b[0] for own in by.values() for a, b in zip(own, own[1:], strict=False)}
    got = {r.id: r.n.id if r.n else None for r in neighbour(frame, ["key"], "at", ["id"], ["id"], "n", width).collect()}
    assert got == {r[0]: after.get(r[0]) for r in rows}
    back = {r.id: r.n.id if r.n else None for r in neighbour(frame, ["key"], "at", ["id"], ["id"], "n", width, -1).collect()}
    assert back == {r[0]: {b: a for a, b in after.items()}.get(r[0]) for r in rows}
    known = {}
    for own in by.values():
        last = None
        for r in own:
            last = r[3] if r[3] is not None else last
            known[r[0]] = last
    assert {r.id: r.k for r in last_known(frame, ["key"], "at", ["id"], F.col("v"), "k", width).collect()} == known
    heights = {r.id: (r.h, r.h_lost) for r in running_height(frame, ["key"], "at", ["id"], F.expr("IF(id % 2 = 0, 1, -1)"), "h", width).collect()}
    for own in by.values():
        height = 0
        for r in own:
            assert heights[r[0]] == (height, r[0] % 2 == 1 and height == 0)
            height = max(0, height + (1 if r[0] % 2 == 0 else -1))


@pytest.mark.parametrize("width", [3, 10**6])
def test_running_sums_and_gap_activity_against_loops(spark, width):
    rng = random.Random(width)
    rows = [(k, rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(90), rng.randrange(5), rng.choice([None, k])) for k in range(200)]
    want = {}
    for key in {r[1] for r in rows}:
        total, last = 0, None
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            want[r[0]] = (total, last)
            total, last = total + r[3], last if r[4] is None else r[4]
    got = running_sums(spark.createDataFrame(rows, "id long, key string, at long, v long, w long"), ["key"], "at", ["id"], ["v"], width, F.col("w"))
    assert {r.id: (r.v, r.last) for r in got.collect()} == want and set(got.columns) == {"id", "key", "at", "v", "w", "last"}
    names = ["swapper/0", "bash", "kworker/1:0", "irq/3-x", "ksoftirqd/0", "vi"]
    runs, at = [], [0, 0]
    for k in range(120):
        cpu, step = rng.randrange(2), rng.randrange(1, 6)
        runs.append((k, at[cpu], None if k > 117 else step, cpu, rng.randrange(6)))
        at[cpu] += step
    sched = spark.createDataFrame(runs, "id long, ts long, dur long, cpu long, utid long")
    thread = spark.createDataFrame([(k, k + 1 if k else 0, n) for k, n in enumerate(names)], "utid long, tid long, name string")
    gaps = analyzer.thread_gaps(sched, thread, None, 3, width)
    found = {(r.utid, r.gap_start, r.gap_end): (r.dominant_context, r.runs) for r in analyzer.gap_activity(gaps, sched, thread, width).collect()}
    kinds, want = ["idle", "user", "kernel_thread", "irq", "softirq", "user"], {}
    for g in gaps.collect():
        inside = [(min(g.gap_end, t + d) - max(g.gap_start, t), kinds[u]) for _, t, d, c, u in runs if d and c == g.cpu and t < g.gap_end and t + d > g.gap_start]
        if inside:
            most = max((sum(x for x, k in inside if k == kind), kind) for kind in set(kinds))[1]
            want[g.utid, g.gap_start, g.gap_end] = (analyzer.CONTEXTS[most], len(inside))
    assert found == want and len(want) > 20
    own = analyzer.thread_gaps(sched, thread, 2, 3, width)
    listed = {(r.gap_start, r.gap_end): r.processes for r in analyzer.gap_processes(own, sched, thread, 7).collect()}
    assert listed == {(g.gap_start, g.gap_end): sorted({names[u] for _, t, d, c, u in runs if d and c == g.cpu and t < g.gap_end and t + d > g.gap_start}) for g in own.collect() if (g.utid, g.gap_start, g.gap_end) in want}


def test_no_row_is_left_out(spark, trace):
    """2,500 rows in each format and analysis."""
    n = 2500
    frame = spark.range(n).selectExpr("id", "concat('t', id) name")
    assert as_table(frame).endswith(f"Total rows: {n}") and as_csv(frame).count("\n") == n + 1 and len(json.loads(as_json(frame))) == n
    assert as_table(frame, 3).splitlines()[-2:] == [f"{n - 3} more rows are not shown.", f"Total rows: {n}"]
    line = lambda k, a, b: f" a-{a} [000] d... {k}.000000: sched_switch: prev_comm=c{a} prev_pid={a} prev_prio=1 prev_state=S ==> next_comm=c{b} next_pid={b} next_prio=1"
    t = trace([line(k, k % 2 + 1, (k + 1) % 2 + 1) for k in range(n + 1)])
    result, a = t.query().execute(), Analyzer(t)
    assert len(result) == n + 1 and result.to_text("raw").count("\n") == n and result.to_text("fields").count("\n") == n and len(json.loads(result.to_json())) == n + 1 and result.to_csv().count("\n") == n + 2
    assert len(a.detect_time_anomalies()["gaps"]) == n and len(a.get_context_timeline(0)) == n + 1
    assert len(a.detect_time_gaps()) == n - 1 and len(a.check_process_running(1, gap_ms=1)["gaps"]) == n // 2 - 1
    assert len(a.detect_time_gaps(n=4)) == 4 and a.detect_time_gaps(2)[0]["cpu_activity"] == {"dominant_context": "user_process", "runs": 1, "processes": ["c1"]}


def test_order_and_groups(trace):
    t = trace(ALIGNMENT)
    last = t.query().order_by("timestamp", False)
    assert last.first()[0].pid == 3711 and [r.pid for r in last.execute()] == [3711, 0, 1234] and last.execute()[0].pid == 3711 and last.limit(1).first()[0].pid == 3711
    grouped = t.query().group_by("comm").execute()
    assert [(r["comm"], r["count"]) for r in grouped] == [("kube-apiserver", 1), ("kworker/u16:0", 1), ("swapper", 1)] and grouped[1]["count"] == 1 and t.query().group_by("cpu").first()[0]["count"] == 3
    assert t.query().group_by("timestamp").count() == 3 and t.query().limit(2).count() == 2
    with pytest.raises(IndexError):
        last.execute()[-4]


def test_statements_counters_and_errors(spark, trace, tmp_path):
    t = trace([*ALIGNMENT, "# comment"])
    assert statements("INCLUDE x.y;\n-- note;\nSELECT ';' AS a;\n\nSELECT 2\n") == ["SELECT ';' AS a", "SELECT 2"]
    assert [f.first()[0] for f in run_statements(t.tables, "SELECT count(*) FROM sched;\nSELECT max(tid) FROM thread")] == [3, 3711]
    assert tuple(counters(read_lines(spark, t.path)).first()) == (4, 3, 3, 1)
    told = write_counted(kernel_log(read_lines(spark, t.path)).select("value"), str(tmp_path / "out"))
    assert told["rows"] == 3 and told["seconds"] > 0 and told["rows_per_second"] > 0 and spark.read.text(str(tmp_path / "out")).count() == 3

    class Odd(dict):
        def __getitem__(self, name):
            raise ValueError("an odd one\nwith lines")

    broken = run_pack(Odd(), (1, 2))
    assert [r.error for r in broken] == ["ValueError: an odd one"] * 2 and "- Failed: 2" in markdown(broken, "x")


def test_plans_stay_small(spark, sf):
    """Each chain reads its source once: no plan has more than a few exchanges, and no gap meets all runs."""
    from tracequarry.sources import samples

    def nodes(frame, kind):
        return len(re.findall(kind, frame._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]))

    stack = samples.stack_events(spark, sf)
    for frame in (derive.flattened(stack, samples.DAY), derive.slices(stack, samples.DAY)):
        assert nodes(frame, "Exchange ") <= 7 and nodes(frame, "FileScan") <= 3


def test_column_functions(spark):
    names = spark.createDataFrame([("spin_lock",), ("Lock",), ("a*b",), ("a.b",), ("x[1]",)], "n string")
    hits = lambda p: [r.n for r in names.where(glob("n", p)).collect()]
    assert hits("*lock*") == ["spin_lock"] and hits("?ock") == ["Lock"] and hits("a.b") == ["a.b"] and hits("a?b") == ["a*b", "a.b"] and hits("[Ls]*") == ["spin_lock", "Lock"]
    kinds = spark.createDataFrame([("bash", 5), ("bash", 0), ("swapper/3", 4), ("ksoftirqd/0", 9), ("irq/4-x", 9), ("kworker/0:1", 9)], "c string, p long").select(process_type("c", "p")).collect()
    assert [r[0] for r in kinds] == ["user", "idle", "idle", "softirq", "irq", "kernel_thread"]
    sizes = spark.createDataFrame([("1.2M",), ("100K",), ("42B",), ("7",), ("x",)], "s string").select(size_value("s")).collect()
    assert [r[0] for r in sizes] == [1_200_000, 100_000, 42, 7, None]


def test_rendering(spark):
    frame = spark.createDataFrame([("a,b", None), ('say "x"', 1.5)], "t string, v double").coalesce(1)
    assert as_csv(frame) == 't,v\n"a,b",\n"say ""x""",1.5\n'
    assert json.loads(as_json(frame))[0] == {"t": "a,b", "v": None}
    assert as_table(frame).splitlines()[0].split() == ["t", "v"] and as_table(frame).endswith("Total rows: 2") and as_table(frame.limit(0)).endswith("Total rows: 0")


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.log").write_text("\n".join(ALIGNMENT[:2]) + "\n")

    def go(frame, name, mode="append"):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
            (folder / "2.log").write_text(ALIGNMENT[2] + "\n" + ALIGNMENT[2].replace("7541.836", "9541.000") + "\n")
            query.processAllAvailable()
            return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]
        finally:
            query.stop()
            (folder / "2.log").unlink(missing_ok=True)

    lines = stream_lines(spark, str(folder))
    assert [r[1:] for r in go(counts(timed(lines)), "counted")] == [(0, "sched_switch", 3)]
    assert [r[2:] for r in go(active_spells(timed(lines)), "spells")] == [(0, 3)]
    assert [r[:2] + r[4:] for r in go(runs(parse_events(lines)), "paired")][:2] == [(0, 0, 1_000_000, "R"), (0, 3711, 1_000_000, "S")]
