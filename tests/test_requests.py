"""Requests that overlap, queue depths, failing calls, periods, and changes of a thread at one time."""

import random

import pytest

from tracequarry.operators import derive, periods, requests
from tracequarry.plans.scenarios import SCENARIOS
from tracequarry.sources.ftrace import parse_events


def _events(spark, lines):
    return parse_events(spark.createDataFrame([(v, k) for k, v in enumerate(lines)], "value string, place long"))


BLOCK = [
    " a-1 [000] d... 1.000000: block_rq_issue: 8,0 WS 4096 () 100 + 8 [a]",
    " a-1 [001] d... 1.000002: block_rq_issue: 8,0 R 4096 () 200 + 8 [a]",
    " a-1 [000] d... 1.000004: block_rq_issue: 8,16 R 4096 () 100 + 8 [a]",
    " a-1 [001] d... 1.000005: block_rq_issue: 8,0 R 512 () 300 + 1 [a]",
    " a-1 [001] d... 1.000009: block_rq_complete: 8,0 WS () 100 + 8 [0]",
    " a-1 [001] d... 1.000010: block_rq_complete: 8,0 R () 300 + 1 [0]",
    " a-1 [000] d... 1.000030: block_rq_complete: 8,0 R () 200 + 8 [0]",
    " a-1 [001] d... 1.000040: block_rq_complete: 8,16 R () 100 + 8 [0]",
]


@pytest.mark.parametrize("width", [3000, 10**9])
def test_requests_over_two_cpus(spark, width):
    events = _events(spark, BLOCK)
    found = derive.trace_tables(events, width=width)["slice"].orderBy("ts").collect()
    assert [(r.id, r.dur, r.name, r.category, r.depth) for r in found] == [(k, d, "block_rq_issue", "block_io", 0) for k, d in ((0, 9000), (1, 28000), (2, 36000), (3, 5000))]
    assert len({r.track_id for r in found}) == 2
    row = SCENARIOS[12].plan(derive.trace_tables(events, width=width)).first()
    assert (row.avg_latency, row.max_latency) == (78000 / 4, 36000)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_random_requests(spark, width):
    """First come, first answered within a key; ends without a begin are lost, begins without an end stay open."""
    rnd = random.Random(width)
    rows = [(rnd.randrange(60), k, rnd.choice("BE"), rnd.randrange(2), rnd.choice([None, 1, 2])) for k in range(400)]
    want, depth, lost = {}, {}, set()
    waiting: dict = {}
    for ts, place, kind, track, sector in sorted(rows, key=lambda r: r[:2]):
        queue = waiting.setdefault((track, sector), [])
        if kind == "B":
            queue.append((ts, place))
            want[place] = None
        elif queue:
            begun, at = queue.pop(0)
            want[at] = ts - begun
        else:
            lost.add(place)
            continue
        depth.setdefault(track, []).append((ts, sum(len(q) for (t, _), q in waiting.items() if t == track)))
    frame = spark.createDataFrame(rows, "ts long, place long, kind string, track_id long, sector long")
    assert {r.place: r.dur for r in requests.paired(frame, width).collect()} == want and lost
    flights = {}
    for track, steps in depth.items():
        flights[track] = [(a, c - a, n) for (a, n), (c, _) in zip(steps, steps[1:], strict=False) if c > a]
    got: dict = {}
    for r in requests.in_flight(frame, width).orderBy("ts").collect():
        got.setdefault(r.track_id, []).append((r.ts, r.dur, r.depth))
    assert got == flights


def test_queue_depth(spark):
    rows = {r.device: r for r in requests.queue_depth(requests.block_requests(_events(spark, BLOCK)), limit=3).collect()}
    a, b = rows["8,0"], rows["8,16"]
    # 1 for 2 us, 2 for 3, 3 for 4, 2 for 1, 1 for 20
    assert (a.requests, a.max_depth, a.median_depth, a.p95_depth, a.full_ns, a.busy_share, a.peak_rate) == (3, 3, 1, 3, 4000, 1.0, 3)
    assert abs(a.mean_depth - (2 + 6 + 12 + 2 + 20) / 30) < 1e-12 and abs(a.rate - 3 / 30e-6) < 1e-6
    assert (b.requests, b.max_depth, b.mean_depth) == (1, 1, 1.0)
    only = requests.queue_depth(requests.block_requests(_events(spark, BLOCK[:1]))).first()
    assert (only.requests, only.mean_depth, only.max_depth) == (1, None, None)
    assert requests.queue_depth(requests.block_requests(_events(spark, []))).count() == 0


def test_messages_of_other_forms(spark):
    lines = [" a-1 [000] d... 1.0: block_rq_issue: 8,0 R 4096", " a-1 [000] d... 2.0: block_rq_complete: 8,0 R", " a-1 [000] d... 3.0: block_rq_issue: nothing", " a-1 [000] d... 4.0: block_rq_complete:"]
    found = requests.paired(requests.block_requests(_events(spark, lines))).orderBy("ts").collect()
    assert [(r.device, r.sector, r.dur) for r in found] == [("8,0", None, 10**9), ("", None, 10**9)]


def test_call_failures(spark):
    said = [(3, "0"), (3, "-11"), (3, "-11"), (3, "-4"), (7, "5"), (7, None), (9, "-12"), (9, "-4")]
    lines = [f" a-1 [000] d... {k}.0: sys_exit: NR {n}" + (f" = {v}" if v else "") for k, (n, v) in enumerate(said)]
    got = {r.name: (r.calls, r.failures, r.error, r.error_count) for r in requests.call_failures(_events(spark, lines)).collect()}
    assert got == {"3": (4, 3, 11, 2), "7": (2, 0, None, None), "9": (2, 2, 4, 1)}


def test_planted_periods(spark):
    rnd, ms = random.Random(5), 10**6
    rows = [("seven", k * 7 * ms) for k in range(400) if rnd.random() < 0.95]
    at = 0
    for _ in range(400):
        at += round(rnd.gauss(10, 0.15) * ms)  # drifts, as a timer that is set anew each time
        rows.append(("ten", at))
    rows += [("ten", rnd.randrange(at)) for _ in range(60)]
    rows += [("random", rnd.randrange(3000 * ms)) for _ in range(500)]
    burst = 0
    for _ in range(500):
        burst += round(rnd.expovariate(1 / (0.2 if rnd.random() < 0.8 else 30)) * ms) + 1
        rows.append(("bursts", burst))
    rows += [("few", k * 5 * ms) for k in range(9)] + [(None, 5), ("seven", None)] + [("still", 77)] * 50
    found = periods.periods(spark.createDataFrame(rows, "key string, ts long"), "key", 50 * ms).where("periodic").collect()
    own = {k: [r.period_ns / ms for r in found if r.key == k] for k in ("seven", "ten", "random", "bursts", "few", "still")}
    assert own["seven"] and min(abs(p - 7) for p in own["seven"]) < 0.1
    assert own["ten"] and min(abs(p - 10) for p in own["ten"]) < 0.3
    assert not own["random"] and not own["bursts"] and not own["few"] and not own["still"]


@pytest.mark.parametrize("width", [10**3, 10**9])
@pytest.mark.parametrize("wake_first", [True, False])
def test_latencies_at_one_time(spark, width, wake_first):
    """A hundred threads, each woken and switched to in the same microsecond; also where the wake-up's line comes second."""
    lines = []
    for k in range(100):
        wake = f" w-5000 [001] dN.. {k}.5: sched_wakeup: comm=t{k} pid={k + 1} prio=120 target_cpu=000"
        switch = f" x-1 [000] d... {k}.5: sched_switch: prev_comm=swapper/0 prev_pid=0 prev_prio=120 prev_state=R ==> next_comm=t{k} next_pid={k + 1} next_prio=120"
        lines += [wake, switch] if wake_first else [switch, wake]
    for place in ("place", "struct('f' AS file_path, 0L AS file_block_start, place AS row)"):
        frame = spark.createDataFrame([(v, k) for k, v in enumerate(lines)], "value string, place long").selectExpr("value", f"{place} AS place")
        t = derive.trace_tables(parse_events(frame), width=width)
        assert t["sched_latency_for_running_interval"].where("latency_dur = 0").count() == 100


def test_depth_times_time_beyond_64_bits(spark):
    """Ten requests that stay open for 10^18 ns pass 2^63 in depth times time, not in time."""
    rows = [(k, k, "B", 7, k, "8,0") for k in range(10)] + [(10**18, 10, "E", 7, 0, "8,0")]
    frame = spark.createDataFrame(rows, "ts long, place long, kind string, track_id long, sector long, device string")
    got = requests.queue_depth(frame, 10**17).first()
    assert (got.requests, got.max_depth, got.median_depth) == (10, 10, 10) and abs(got.mean_depth - 10) < 1e-9


def test_average_of_a_sum_beyond_64_bits(spark):
    rows = [(k, "block_rq_issue", "block_io", 4 * 10**18 + k) for k in range(4)]
    frame = spark.createDataFrame(rows, "id long, name string, category string, dur long")
    got = SCENARIOS[12].plan({"slice": frame}).first()
    assert (got.avg_latency, got.max_latency) == (4e18, 4 * 10**18 + 3)
