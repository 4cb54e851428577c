"""The driver's tables as a trace: its relational tables directly, and trace text that the parsers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import neighbour
from ..operators.derive import Tables

#: State letters of the kinds of events, and the epoch that trace times count from, in microseconds.
STATE_OF = "CASE event_type WHEN 'click' THEN 'R' WHEN 'view' THEN 'S' WHEN 'purchase' THEN 'D' WHEN 'error' THEN 'X' WHEN 'signup' THEN 'Z' END"
EPOCH_US = 1704067200000000
#: Width of the windows' buckets: these events are minutes apart.
DAY = 86_400 * 10**9
#: Customers whose lines one task makes.
DEALT = 10_000

_COMM = """CASE WHEN {u} = 0 THEN 'swapper/0' WHEN {u} % 10 = 1 THEN 'qemu-kvm' WHEN {u} % 10 = 2 THEN concat('vhost-', {u})
WHEN {u} % 10 = 3 THEN concat('kworker/', {u}, ':0') WHEN {u} % 10 = 4 THEN concat('ksoftirqd/', {u} % 8)
WHEN {u} % 10 = 5 THEN concat('irq/', {u}, '-eth0') ELSE concat('proc', {u}) END"""


def comm(user: str) -> str:
    """SQL for the name of the thread that stands for a user."""
    return _COMM.format(u=user)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """sched, thread_state, thread, process, slice, track, counter, counter_track and the IRQ views, from driver tables."""
    events = _table(spark, sf_dir, "events").selectExpr("event_id id", "unix_micros(CAST(ts AS timestamp)) * 1000 ts", "user_id utid", "event_type", "pmod(user_id, 8) cpu")
    slices = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    slices = slices.selectExpr(
        "l_orderkey * 8 + l_linenumber id", "unix_micros(CAST(l_shipdate AS timestamp)) * 1000 ts", "CAST(l_quantity * 1000000 AS BIGINT) dur",
        "l_suppkey track_id", "p_type category", "p_name name", "CAST(l_linenumber AS BIGINT) depth",
    )
    tracks = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "IF(s_nationkey < 12, 'cpu_irq', 'cpu_softirq') type")
    irqs = slices.join(tracks.select(F.col("id").alias("track_id"), "type"), "track_id")

    def sched(t: Tables) -> DataFrame:
        return neighbour(events, ["cpu"], "ts", ["id"], ["ts"], "next", DAY).selectExpr("id", "ts", "next.ts - ts dur", "cpu", "utid", f"{STATE_OF} end_state")

    def states(t: Tables) -> DataFrame:
        woken = neighbour(events, ["cpu"], "ts", ["id"], ["utid"], "waker", DAY, -1)
        return neighbour(woken, ["utid"], "ts", ["id"], ["ts"], "next", DAY).selectExpr("id", "ts", "next.ts - ts dur", "utid", f"{STATE_OF} state", "waker.utid waker_utid")

    return Tables(
        {
            "thread": lambda t: _table(spark, sf_dir, "customer").selectExpr("c_custkey utid", "c_custkey tid", "c_name name", "CAST(c_nationkey AS BIGINT) upid"),
            "process": lambda t: _table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) upid", "n_name name"),
            "sched": sched,
            "thread_state": states,
            "slice": lambda t: slices,
            "track": lambda t: tracks,
            "linux_hard_irqs": lambda t: irqs.where("type = 'cpu_irq'").select("ts", "dur", "name", "id"),
            "linux_soft_irqs": lambda t: irqs.where("type = 'cpu_softirq'").select("ts", "dur", "name", "id"),
            "counter": lambda t: _table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "unix_micros(CAST(o_orderdate AS timestamp)) * 1000 ts", "o_custkey track_id", "o_totalprice value"),
            "counter_track": lambda t: _table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_mktsegment name"),
        }
    )


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace text (value, place) from events: a switch for each, a wake-up before each error, and a comment now and then."""
    found = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id u", "event_type", "unix_micros(CAST(ts AS timestamp)) us", f"{STATE_OF} st", "lpad(CAST(pmod(user_id, 8) AS STRING), 3, '0') cpu")
    found = neighbour(found, ["cpu"], "us", ["event_id"], ["u"], "before", DAY // 1000, -1)
    found = found.selectExpr("*", "coalesce(before.u, 0) p", f"concat(CAST((us - {EPOCH_US}) div 1000000 AS STRING), '.', lpad(CAST((us - {EPOCH_US}) % 1000000 AS STRING), 6, '0')) sec", "(u * 7 + 3) % 150 w")
    switch = f"""concat('  ', {comm('p')}, '-', p, ' [', cpu, '] d... ', sec, ': sched_switch: prev_comm=', {comm('p')}, ' prev_pid=', p,
      ' prev_prio=120 prev_state=', st, ' ==> next_comm=', {comm('u')}, ' next_pid=', u, ' next_prio=', 100 + u % 40)"""
    wake = f"concat(' ', {comm('p')}, '-', p, ' [', cpu, '] dN.. ', sec, ': sched_wakeup: comm=', {comm('w')}, ' pid=', w, ' prio=120 target_cpu=', cpu)"
    comment = "IF(event_id % 50 = 0, named_struct('value', '# tracer: nop', 'place', event_id * 4), NULL)"
    lines = f"array({comment}, IF(event_type = 'error', named_struct('value', {wake}, 'place', event_id * 4 + 1), NULL), named_struct('value', {switch}, 'place', event_id * 4 + 2))"
    return found.select(F.explode(F.expr(f"filter({lines}, x -> x IS NOT NULL)")).alias("x")).select("x.value", "x.place")


def stack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins and ends of slices (ts, track_id, kind, category, name, place) from events; more begin than end."""
    return _table(spark, sf_dir, "events").selectExpr(
        "unix_micros(CAST(ts AS timestamp)) * 1000 ts", "pmod(user_id, 8) track_id", "IF(event_type IN ('error', 'signup'), 'E', 'B') kind",
        "event_type category", "concat('f', user_id % 20) name", "event_id place",
    )


def interrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace text (value, place) from events: begins and ends of interrupts, system calls and block requests, and counters."""
    found = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id u", "event_type", f"unix_micros(CAST(ts AS timestamp)) - {EPOCH_US} us", "lpad(CAST(pmod(user_id, 8) AS STRING), 3, '0') cpu")
    says = {
        "click": ("concat('irq_handler_entry: irq=', u % 9, ' name=dev', u % 9)", "concat('irq_handler_exit: irq=', u % 9, ' ret=handled')"),
        "view": ("concat('softirq_entry: vec=', u % 5, ' [action=NET', u % 5, ']')", "concat('softirq_exit: vec=', u % 5, ' [action=NET', u % 5, ']')"),
        "purchase": ("concat('sys_enter: NR ', u % 30, ' (0, 0)')", "concat('sys_exit: NR ', u % 30, ' = 0')"),
        "error": ("concat('block_rq_issue: 8,0 R 4096 () ', event_id * 8, ' + 8 [app]')", "concat('block_rq_complete: 8,0 R () ', event_id * 8, ' + 8 [0]')"),
        "signup": ("concat('cpu_frequency: state=', u * 1000, ' cpu_id=', cpu)", "NULL"),
    }
    pick = lambda k: " ".join(f"WHEN '{e}' THEN {s[k]}" for e, s in says.items())
    at = lambda us: f"concat(CAST(({us}) div 1000000 AS STRING), '.', lpad(CAST(({us}) % 1000000 AS STRING), 6, '0'))"
    line = lambda k, us: f"concat(' p', u, '-', u, ' [', cpu, '] d... ', {at(us)}, ': ', CASE event_type {pick(k)} END)"
    both = f"array(named_struct('value', {line(0, 'us')}, 'place', event_id * 2), named_struct('value', {line(1, 'us + 1 + u % 7')}, 'place', event_id * 2 + 1))"
    return found.select(F.explode(F.expr(f"filter({both}, x -> x.value IS NOT NULL)")).alias("x")).select("x.value", "x.place")


def _at(us: str) -> str:
    """SQL for a trace's seconds from microseconds."""
    return f"concat(CAST(({us}) div 1000000 AS STRING), '.', lpad(CAST(({us}) % 1000000 AS STRING), 6, '0'))"


def _lines_of(frame: DataFrame, *lines: str) -> DataFrame:
    """Trace text (value, place) of the lines that aren't null of each event; place is the event's number and the line's."""
    made = ", ".join(f"named_struct('value', {line}, 'place', event_id * {len(lines)} + {k})" for k, line in enumerate(lines))
    return frame.select(F.explode(F.expr(f"filter(array({made}), x -> x.value IS NOT NULL)")).alias("x")).select("x.value", "x.place")


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace text of block requests from events, which overlap and end on another CPU; a few sectors of three devices.

    A signup's request never ends, and an error is an end whose begin lies before the trace.
    """
    found = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id u", "event_type", f"unix_micros(CAST(ts AS timestamp)) - {EPOCH_US} us", "event_id % 50 * 8 sector", "(1 + (user_id * 37 + event_id) % 11) * 2400000000L lag")
    said = "concat(' p', u, '-', u, ' [', lpad(CAST(pmod({cpu}, 8) AS STRING), 3, '0'), '] d... ', {at}, ': {event}: 8,', u % 3 * 16, ' WS {size}() ', {sector}, ' + 8 [{last}]')"
    issue = said.format(cpu="u", at=_at("us"), event="block_rq_issue", size="4096 ", sector="sector", last="app")
    complete = said.format(cpu="u + 3", at=_at("us + lag"), event="block_rq_complete", size="", sector="IF(event_type = 'error', 1000000 + event_id, sector)", last="0")
    return _lines_of(found, f"IF(event_type <> 'error', {issue}, NULL)", f"IF(event_type <> 'signup', {complete}, NULL)")


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace text of the ends of system calls from events; errors and signups are failures."""
    found = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id u", f"unix_micros(CAST(ts AS timestamp)) - {EPOCH_US} us", "CASE event_type WHEN 'error' THEN -11 - user_id % 2 WHEN 'signup' THEN -4 ELSE event_id % 7 END value")
    return _lines_of(found, f"concat(' p', u, '-', u, ' [000] d... ', {_at('us')}, ': sys_exit: NR ', u % 30, ' = ', value)")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times (key, ts) from events: every 7 ms; every 10 ms with jitter of 0.3 ms and one in ten missing; spread at random;
    as they are."""
    found = _table(spark, sf_dir, "events").selectExpr("event_id", "event_id div 4 n", "user_id u", "unix_micros(CAST(ts AS timestamp)) * 1000 ts", "event_id % 4 kind")
    each = f"CASE kind WHEN 0 THEN n * 7000000 WHEN 1 THEN n * 10000000 + (u * 37 + event_id * 11) % 601 * 1000 - 300000 WHEN 2 THEN (event_id * 7919 + u * 104729) * 1000003 % 20000000000 ELSE ts - {EPOCH_US} * 1000 END"
    return found.where("kind <> 1 OR u % 10 <> 3").selectExpr("CAST(kind AS BIGINT) key", f"{each} ts")


#: Sections of a made-up crash report: command, and the line numbers from which its lines stand.
SECTIONS = {"sys": 0, "ps": 10**7, "kmem -s": 2 * 10**7, "log": 3 * 10**7, "foreach bt": 4 * 10**7, "irq": 5 * 10**7, "timer": 6 * 10**7, "mod": 7 * 10**7, "kmem -i": 8 * 10**7}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report and k of the customers, dealt out by their number: each makes a dozen lines, and a file of few splits would put
    millions of lines into a task. The rows are counted from the file's footers."""
    found = _table(spark, sf_dir, "customer").selectExpr("concat('r', c_nationkey) report", "c_custkey k")
    return found.repartition(max(1, -(-found.count() // DEALT)), "k")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash reports (report, line_no, text) from customers: one for each nation, with a section for each command.

    For each customer k there are a task, a slab cache, a kernel message, a stack, a timer, and a lock that it waits for
    and that another holds; for each nation an interrupt, a module and summaries.
    """
    each = _customers(spark, sf_dir)
    kinds = (
        "concat('BUG: soft lockup - CPU#', k % 8, ' stuck')", "concat('Out of memory: Kill process ', k)", "concat('INFO: task t', k, ' blocked for more than 120 seconds')",
        "concat('EXT4-fs error (device sda', k % 4, ')')", "'usb 1-1: firmware ready'", "'fault at 6b6b6b6b6b6b6b6b, kdump: saving'",
    )
    message = "CASE k % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(kinds)) + " END"
    address = lambda of: f"concat('ffff8800', lpad(hex({of}), 8, '0'))"
    task = f"concat('  ', k, '  1  ', k % 8, '  ', lower({address('k')}), '  ', IF(k % 3 = 0, 'UN', 'RU'), '  0.1  ', k * 10, '  ', k * 7 % 1000, '  comm', k % 20)"
    slab = "concat('cache', k, '  ', k % 5 * 100, '  ', k % 5 * 100 - k % 2 * k % 5, '  ', k % 5 * 100, '  ', 64 + k % 3, 'B')"
    rows = {
        10**7: ("k", task), 2 * 10**7: ("k", slab), 3 * 10**7: ("k", f"concat('[', k, '.', lpad(k % 1000, 6, '0'), '] ', {message})"), 6 * 10**7: ("k", f"concat('  ', 4295000000 + k, '  ', lower({address('k')}), '  ffffffff81075abc  <timer_fn', k % 5, '>')"),
    }
    lines = [f"named_struct('line_no', CAST({at} + {n} + 1 AS BIGINT), 'text', {text})" for at, (n, text) in rows.items()]
    stack = (f"concat('PID: ', k, '    TASK: ', lower({address('k')}), '  CPU: 1  COMMAND: \"x\"')", "'#0 [ffff88] schedule'", "concat('#1 [ffff88] ', IF(k % 4 = 0, 'mutex_lock', concat('fn', k % 7)), '+0x45')")
    lines += [f"named_struct('line_no', CAST({4 * 10**7} + 4 * k + {n + 1} AS BIGINT), 'text', {text})" for n, text in enumerate(stack)]
    lock = ("concat('>>> Command: waitq ', lower({a}))", "concat('PID: ', k, '   TASK: ', lower({t}), '  CPU: 1   COMMAND: \"x\"')", "concat('>>> Command: struct mutex ', lower({a}))", "concat('  owner = 0x', lower({o}), ',')")
    lines += [f"named_struct('line_no', CAST({9 * 10**7} + 5 * k + {n} AS BIGINT), 'text', {text.format(a=address('1000000 + k'), t=address('k'), o=address('k * k % 97'))})" for n, text in enumerate(lock)]
    made = each.select("report", F.explode(F.expr(f"array({', '.join(lines)})")).alias("x")).select("report", "x.line_no", "x.text")
    nations = _table(spark, sf_dir, "nation").selectExpr("concat('r', n_nationkey) report", "n_nationkey n")
    heads = [f"named_struct('line_no', CAST({at} AS BIGINT), 'text', '>>> Command: {command}')" for command, at in SECTIONS.items()]
    own = {
        1: "'    KERNEL: vmlinux-6'", 2: "concat('     PANIC: \"Oops: ', n, '\"')", 5 * 10**7 + 1: "concat('  ', n, ':  ', n * 100, '  ', n * 3, '  IO-APIC-fasteoi  eth', n)",
        7 * 10**7 + 1: "concat('ffffffffa00', lpad(n, 5, '0'), '  mod', n, '  ', 4096 + n, '  (not loaded)')", 8 * 10**7 + 1: "concat('    TOTAL MEM: ', 10 + n, ' GB')",
    }
    heads += [f"named_struct('line_no', CAST({at} AS BIGINT), 'text', {text})" for at, text in own.items()]
    return made.union(nations.select("report", F.explode(F.expr(f"array({', '.join(heads)})")).alias("x")).select("report", "x.line_no", "x.text"))


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash reports (report, line_no, text) from customers, one for each nation: open files of each task, mounts, devices and
    run queues of eight CPUs."""
    each = _customers(spark, sf_dir)
    address = lambda of: f"lower(concat('ffff8800', lpad(hex({of}), 8, '0')))"
    pid = f"concat('PID: ', k, '    TASK: ', {address('k')}, '  CPU: ', k % 8, '   COMMAND: \"comm', k % 20, '\"')"
    files = (
        pid, "'ROOT: /    CWD: /root'", "' FD       FILE            DENTRY           INODE       TYPE PATH'",
        f"concat('  0 ', {address('k + 1')}, ' ', {address('k + 2')}, ' ', {address('k + 3')}, ' CHR  /dev/pts/', k % 5)",
        f"IF(k % 3 = 0, concat(' 17 ', {address('k + 4')}, ' ', {address('k + 5')}, ' ', {address('k + 6')}, ' SOCK '), NULL)",
    )
    lines = [f"named_struct('line_no', CAST({10**6} + 8 * k + {n} AS BIGINT), 'text', {text})" for n, text in enumerate(files)]
    lines += [
        f"named_struct('line_no', CAST({2 * 10**8} + k AS BIGINT), 'text', concat({address('k')}, ' ', {address('k + 9')}, ' ', IF(k % 2 = 0, 'ext4', 'tmpfs'), '   /dev/sd', k % 7, '  /mnt/disk ', k))",
        f"named_struct('line_no', CAST(IF(k % 2 = 0, {3 * 10**8}, {4 * 10**8}) + k AS BIGINT), 'text', concat('  ', k % 250, '      name', k % 20, '  ', IF(k % 5 = 0, '(none)', {address('k')}), IF(k % 5 = 0, '', '  some_fops')))",
        f"named_struct('line_no', CAST({5 * 10**8} + (k % 8) * {10**7} + IF(k % 3 = 0, 2000000, 4000000) + k AS BIGINT), 'text', concat('     [', 100 + k % 40, '] PID: ', k, '   TASK: ', {address('k')}, '  COMMAND: \"comm', k % 20, '\"'))",
    ]
    made = each.select("report", F.explode(F.expr(f"filter(array({', '.join(lines)}), x -> x.text IS NOT NULL)")).alias("x")).select("report", "x.line_no", "x.text")
    nations = _table(spark, sf_dir, "nation").selectExpr("concat('r', n_nationkey) report")
    heads = {0: ">>> Command: foreach files", 2 * 10**8 - 2: ">>> Command: mount", 2 * 10**8 - 1: "     MOUNT           SUPERBLK     TYPE   DEVNAME   DIRNAME", 3 * 10**8 - 2: ">>> Command: dev", 3 * 10**8 - 1: "CHRDEV    NAME                 CDEV        OPERATIONS", 4 * 10**8 - 1: "BLKDEV    NAME                GENDISK      OPERATIONS", 5 * 10**8 - 1: ">>> Command: runq"}
    for cpu in range(8):
        at = 5 * 10**8 + cpu * 10**7
        heads |= {at: f"CPU {cpu} RUNQUEUE: ffff88003fc{cpu:05d}", at + 1: "  CURRENT: PID: 0      TASK: ffffffff81c10440  COMMAND: \"swapper\"", at + 1_999_999: "  RT PRIO_ARRAY: ffff88003fc137d0", at + 3_999_999: "  CFS RB_ROOT: ffff88003fc13718"}
    said = ", ".join(f"named_struct('line_no', CAST({n} AS BIGINT), 'text', '{text}')" for n, text in heads.items())
    return made.union(nations.select("report", F.explode(F.expr(f"array({said})")).alias("x")).select("report", "x.line_no", "x.text"))
