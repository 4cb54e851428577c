from pyspark.sql import functions as F

from tracequarry.functions import ordered
from tracequarry.functions.store import at_hand
from tracequarry.operators import crash
from tracequarry.plans.rules import abnormal, stall_level, switch_meaning, verdicts
from tracequarry.sources import crash as source
from tracequarry.sources import samples

REPORT = """CRASH ANALYSIS REPORT
>>> Command: sys
>>> Description: overview
    KERNEL: vmlinux
    PANIC: "Out of memory: Kill process 1234 (myapp)"
>>> Command: log | tail -100
[12345.678] Out of memory: Kill process 1234 (myapp) score 9 or sacrifice child
[12345.679] Killed process 1234 (myapp) total-vm:2048000kB
[12346.000] INFO: task a:1 blocked for more than 120 seconds
[12347.000] BUG: unable to handle kernel NULL pointer dereference at 0000000000000008
>>> Command: ps
  PID    PPID  CPU       TASK        ST  %MEM     VSZ    RSS  COMM
>  1234   1     2   ffff8800345fb040  RU   1.2  123456  45678  myapp
   1235   1     3   ffff8800345fb041  UN   0.0  0  0  kworker/3:1
>>> Command: kmem -i
        TOTAL  MEM: 16 GB
         USED: 15.9 GB (99.4%)
>>> Command: kmem -s
CACHE              OBJS   ACTIVE  TOTAL   SIZE
xyz_buffer_cache   100M   100M    100M    42B
dentry_cache       120K   118K    120K    192
>>> Command: foreach bt
PID: 12    TASK: ffff880012340000  CPU: 2  COMMAND: "x"
#0  schedule
#1 [ffff88] kmem_cache_alloc+0x45
PID: 13    TASK: ffff880012340001  CPU: 2  COMMAND: "y"
#0  schedule
"""


def test_report_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text(REPORT)
    (tmp_path / "b.txt").write_text("nothing here\n")
    lines = source.sections(source.read_reports(spark, str(tmp_path)))
    assert lines.where("section = 'ps'").count() == 4 and lines.where("section IS NULL AND report = 'a.txt'").count() == 1
    assert [(r.pid, r.st, r.rss, r.comm) for r in source.ps(lines).orderBy("pid").collect()] == [(1234, "RU", 45678, "myapp"), (1235, "UN", 0, "kworker/3:1")]
    slab = source.slab(lines.where("section = 'kmem -s'"))
    assert {r.cache: (r.objs, r.active, r["size"]) for r in slab.collect()} == {"xyz_buffer_cache": (100_000_000, 100_000_000, 42), "dentry_cache": (120_000, 118_000, 192)}
    assert [(r.cache, r.bytes, r.suspect) for r in crash.leaks(slab, 16 * 10**9).collect()] == [("xyz_buffer_cache", 4_200_000_000, True)]
    assert [r.cache for r in crash.largest(slab, "objs", 1).collect()] == ["xyz_buffer_cache"]
    assert [str(r.ts_sec) for r in source.log(lines).orderBy("ts_sec").collect()][0] == "12345.678000"
    assert {(r.label, r.bytes) for r in source.memory(lines.where("section = 'kmem -i'")).collect()} == {("TOTAL  MEM", 16_000_000_000), ("USED", 15_900_000_000)}
    assert {r.key for r in source.system(lines.where("section = 'sys'")).collect()} == {"KERNEL", "PANIC"}
    frames = source.frames(lines)
    assert {(r.pid, r.idx, r.func) for r in frames.collect()} == {(12, 0, "schedule"), (12, 1, "kmem_cache_alloc"), (13, 0, "schedule")}
    assert {r.func: r.stacks for r in crash.callers(frames, "kmem_cache_alloc").collect()} == {"schedule": 1, "kmem_cache_alloc": 1}
    found = crash.signatures(lines).orderBy("line_no").collect()
    assert [r["class"] for r in found] == ["out_of_memory", "out_of_memory", "out_of_memory", "blocked_task", "null_dereference"] and [r.is_first for r in found] == [True] + [False] * 4
    assert {r.report: r.phase for r in crash.phase(lines).collect()} == {"a.txt": "memory", "b.txt": "unknown"}
    assert {r.pattern for r in crash.quick_patterns(lines).collect()} == {"panic", "memory", "deadlock"}
    assert [r.p for r in lines.select(crash.poison().alias("p")).where("p IS NOT NULL").collect()] == ["null_pointer"]
    assert lines.select(crash.cause_of_dump().alias("c")).where("c = 'fault'").count() == 1
    assert [r.text for r in crash.last_lines(lines.where("report = 'a.txt' AND text <> ''"), 1).collect()] == ["#0  schedule"]


def test_context_is_taken_once(spark):
    lines = spark.createDataFrame([("r", k, "hit" if k in (3, 4, 9) else "x") for k in range(12)], "report string, line_no long, text string")
    assert sorted(r.line_no for r in crash.context(lines, F.col("text") == "hit", 1, 2).collect()) == [2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert crash.context(lines, F.lit(False)).count() == 0
    ends = crash.first_and_last(lines, F.col("text") == "hit").first()
    assert (ends.hits, ends.span) == (3, 6)


def test_rings(spark):
    def found(edges):
        return {(r.task, r.ring, r.length) for r in crash.wait_rings(spark.createDataFrame(edges, "task long, owner long")).collect()}

    assert found([(1, 2), (2, 1), (3, 1), (4, 5), (5, 6), (6, 4), (7, 7), (8, 9), (9, None)]) == {(1, 1, 2), (2, 1, 2), (4, 4, 3), (5, 4, 3), (6, 4, 3), (7, 7, 1)}
    assert found([(1, 2), (2, 3)]) == set() and found([(None, 1)]) == set()
    assert found([(k, (k + 1) % 40) for k in range(40)]) == {(k, 0, 40) for k in range(40)}


def test_difference(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "v int") for v in ([1, 1, 2], [1, 3]))
    assert sorted(tuple(r) for r in crash.difference(a, b).collect()) == [("<", 1), ("<", 2), (">", 3)]
    assert crash.commands_for("memory") == ["kmem -i", "kmem -s"] and crash.commands_for("other") == []


def test_locks_interrupts_and_modules(spark):
    text = """>>> Command: waitq ffff880000000010
PID: 7   TASK: ffff880000000007  CPU: 1   COMMAND: "a"
>>> Command: struct mutex ffff880000000010
  owner = 0xffff880000000008,
>>> Command: waitq ffff880000000020
PID: 8   TASK: ffff880000000008  CPU: 1   COMMAND: "b"
>>> Command: struct mutex ffff880000000020
  owner = (struct task_struct *) 0xffff880000000007,
>>> Command: irq
 17:  100  20   IO-APIC-fasteoi  eth0
>>> Command: timer
  4295000000  ffff880000000099  ffffffff81075abc  <delayed_work_timer_fn>
>>> Command: mod
ffffffffa0001040  ext4  371265  (not loaded)  [CONFIG_KALLSYMS]"""
    lines = source.sections(spark.createDataFrame([("r", k, t) for k, t in enumerate(text.split("\n"))], "report string, line_no long, text string"))
    edges = source.wait_edges(lines)
    assert {(r.lock[-2:], r.task[-1], r.owner[-1]) for r in edges.collect()} == {("10", "7", "8"), ("20", "8", "7")}
    assert {(r.task[-1], r.length) for r in crash.wait_rings(edges.select("task", "owner")).collect()} == {("7", 2), ("8", 2)}
    assert [(r.irq, r["count"], r.handler, r.device) for r in source.interrupts(lines.where("section = 'irq'")).collect()] == [(17, 120, "IO-APIC-fasteoi", "eth0")]
    assert [(r.expires, r.func) for r in source.timers(lines).collect()] == [(4295000000, "delayed_work_timer_fn")]
    assert [(r.name, r["size"]) for r in source.modules(lines).collect()] == [("ext4", 371265)]


def test_borders_of_rules(spark):
    frame = spark.createDataFrame([(10_000,), (10_001,), (100_001,), (1_000_000,), (1_000_001,), (10_000_001,), (None,)], "v long")
    assert [r[0] for r in frame.select(stall_level("v")).collect()] == ["normal", "short", "noticeable", "noticeable", "system", "system", None]
    assert [r[0] for r in frame.select(abnormal("max_latency", "v")).collect()] == [False] * 5 + [True, None]
    assert [r.abnormal for r in verdicts(frame, "avg_slice_dur", "v").collect()] == [True, True, True, False, False, False, False]
    states = spark.createDataFrame([("R+",), ("S",), ("D",), ("Z",)], "s string").select(switch_meaning("s")).collect()
    assert [r[0] for r in states] == ["preempted", "sleeps", "blocked", "other"]


def test_lines_of_many_customers_are_many_tasks(spark, tmp_path):
    """A file of one split holds 25,000 customers; their lines are made by as many tasks as they need, and read at hand."""
    spark.range(25_000).selectExpr("id c_custkey", "CAST(id % 25 AS INT) c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(25).selectExpr("CAST(id AS INT) n_nationkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    for made in (samples.report_lines(spark, str(tmp_path)), samples.nested_lines(spark, str(tmp_path))):
        assert made.rdd.getNumPartitions() >= 4 and at_hand(made)


def test_tasks_of_a_window_grow_with_the_rows(spark, monkeypatch):
    """More lines come to more tasks than there are shuffle partitions, with the values of the plain window."""
    monkeypatch.setattr(ordered, "SORTED", 50)
    monkeypatch.setattr(source, "LINES", 20)
    lines = spark.range(4000).selectExpr("concat('r', id % 3) report", "id line_no", "IF(id % 7 = 0, concat('>>> Command: c', id), 'x') text").repartition(3)
    found = source.sections(lines)
    want = {(r, n): max((k for k in range(n, max(-1, n - 22), -1) if k % 7 == 0 and k % 3 == n % 3), default=None) for n in range(4000) for r in [f"r{n % 3}"]}
    assert {(r.report, r.line_no): r.section_line for r in found.collect()} == want
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) > 30 and max(by_task) < 400
