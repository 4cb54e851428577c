"""Questions on the lines and tables of crash reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import kept

# Quick patterns and signatures, as the kernel words its messages.
QUICK = {
    "panic": "panic|oops|bug:|kernel bug",
    "memory": "out of memory|oom|allocation fail",
    "deadlock": "blocked for|hung task|deadlock",
    "hardware": "hardware error|mce|machine check",
    "driver": "timeout|firmware|driver.*fail",
    "filesystem": "ext4-fs|xfs|io error",
}
SIGNATURES = (
    ("hard_lockup", r"BUG: hard lockup"),
    ("soft_lockup", r"BUG: soft lockup"),
    ("rcu_stall", r"self-detected stall on CPU"),
    ("null_dereference", r"unable to handle kernel NULL pointer dereference"),
    ("general_protection_fault", r"general protection fault"),
    ("stack_overflow", r"stack overflow detected|Double fault"),
    ("out_of_memory", r"Out of memory: Kill process|Killed process \d+"),
    ("blocked_task", r"blocked for more than \d+ seconds"),
    ("slab_corruption", r"slab error in|Freepointer corrupt"),
    ("bad_page", r"BUG: Bad page (map|state)"),
    ("dma", r"DMA: Out of SW-IOMMU space|DMAR: DRHD: handling fault"),
    ("filesystem", r"EXT4-fs error|XFS: Internal error"),
    ("device_timeout", r"timeout waiting for"),
    ("network_rate_limit", r"net_ratelimit: "),
    ("vfs_wait", r"do_sys_open|vfs_read|vfs_write"),
)
POISON = (("use_after_free", r"6b6b6b6b"), ("redzone", r"5a5a5a5a"), ("null_pointer", r"at 0{12,16}[0-9a-f]{0,3}\b"))
COMMANDS = (("hang", "ps | grep UN"), ("hang", "foreach UN bt"), ("slow", "runq"), ("slow", "kmem -i"), ("memory", "kmem -i"), ("memory", "kmem -s"), ("network", "net"), ("network", "log | grep -i net"))


def last_lines(lines: DataFrame, n: int, key: str = "report", order: str = "line_no") -> DataFrame:
    """The last n lines of each report.

    Spark keeps n lines of each report for each task before it shuffles them (a window with a rank limit), so a report of
    any length comes to one task as n lines a task.
    """
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return lines.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def largest(frame: DataFrame, column: str, n: int = 20, *ties: str) -> DataFrame:
    """The n rows with the largest value of a column."""
    return frame.orderBy(F.desc_nulls_last(column), *ties).limit(n)


def like(column: str, pattern: str) -> Column:
    """Whether a text holds a pattern in either case."""
    return F.col(column).rlike(f"(?i){pattern}")


def quick_patterns(lines: DataFrame, key: str = "report") -> DataFrame:
    """How many lines of each report have each quick pattern: key, pattern, lines; only patterns that occur."""
    hits = F.filter(F.array(*[F.when(like("text", p), n) for n, p in QUICK.items()]), lambda x: x.isNotNull())
    return lines.select(key, F.explode(hits).alias("pattern")).groupBy(key, "pattern").agg(F.count("*").alias("lines"))


def signature(column: str = "text") -> Column:
    """The first signature that a line has, or null."""
    found = F.when(F.col(column).rlike(SIGNATURES[0][1]), SIGNATURES[0][0])
    for name, pattern in SIGNATURES[1:]:
        found = found.when(F.col(column).rlike(pattern), name)
    return found


def signatures(lines: DataFrame) -> DataFrame:
    """Lines with a signature, and for each report which was first: a later one may come of handling it."""
    found = kept(lines.withColumn("class", signature()).where("class IS NOT NULL").select("report", "line_no", "class", "text"), "signatures")
    firsts = found.groupBy("report").agg(F.min("line_no").alias("first_line"))
    return found.join(firsts, "report").select("report", "line_no", "class", (F.col("line_no") == F.col("first_line")).alias("is_first"), "text")


def poison(column: str = "text") -> Column:
    """What an address in a line says of the fault, or null."""
    found = F.when(F.col(column).rlike(POISON[0][1]), POISON[0][0])
    for name, pattern in POISON[1:]:
        found = found.when(F.col(column).rlike(pattern), name)
    return found


def context(lines: DataFrame, hit: Column, before: int = 0, after: int = 0, key: str = "report", order: str = "line_no") -> DataFrame:
    """Lines with a hit and those around it, each once. order is dense (1 apart) within a key.

    Each hit names the places that it takes along, so there is no window over a whole report.
    """
    near = lines.where(hit).select(F.col(key).alias("__key"), F.explode(F.sequence(F.col(order) - before, F.col(order) + after)).alias("__at")).distinct()
    return lines.join(near, F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) == F.col("__at")), "left_semi")


def first_and_last(lines: DataFrame, hit: Column, key: str = "report", order: str = "line_no") -> DataFrame:
    """Of each report: lines with a hit, the first and the last of them, and how far apart."""
    text = F.struct(order)
    found = lines.where(hit).groupBy(key).agg(F.count("*").alias("hits"), F.min_by("text", text).alias("first_text"), F.max_by("text", text).alias("last_text"), (F.max(order) - F.min(order)).alias("span"))
    return found


def callers(frames: DataFrame, pattern: str) -> DataFrame:
    """Functions on the stacks that have a frame of the pattern, and on how many stacks each stands."""
    stacks = frames.where(F.col("func").rlike(pattern)).select("report", "pid").distinct()
    return frames.join(stacks, ["report", "pid"], "left_semi").select("report", "pid", "func").distinct().groupBy("func").agg(F.count("*").alias("stacks"))


def wait_rings(waits: DataFrame) -> DataFrame:
    """Rings in waits(task, owner): tasks that wait for each other in a circle; a task waits for one owner at most.

    With a column report, tasks of different reports are different, whatever their addresses. Following the owners 2^k
    steps at once, after at least as many steps as there are tasks only ring members are reached. Each round joins the
    table with itself by one key; the number of rounds is the logarithm of the tasks of a report. Returns task, ring (the
    least task of it) and length, and report if there is one.
    """
    by = ["report"] if "report" in waits.columns else []
    step = kept(waits.where("task IS NOT NULL AND owner IS NOT NULL").groupBy(*by, "task").agg(F.min("owner").alias("owner")), "waits")
    n = step.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    jump, done = step.select(*by, "task", F.col("owner").alias("to"), F.least("task", "owner").alias("low")), 1
    while done < n:
        further = jump.select(*by, F.col("task").alias("to"), F.col("to").alias("__to"), F.col("low").alias("__low"))
        jump = kept(jump.join(further, [*by, "to"]).select(*by, "task", F.col("__to").alias("to"), F.least("low", "__low").alias("low")), "waits")
        done *= 2
    members = jump.select(*by, F.col("to").alias("task")).distinct()
    rings = members.join(jump.select(*by, "task", F.col("low").alias("ring")), [*by, "task"])
    return rings.join(rings.groupBy(*by, "ring").agg(F.count("*").alias("length")), [*by, "ring"]).select(*by, "task", "ring", "length")


def leaks(slab: DataFrame, memory_bytes: int, share: float = 0.1) -> DataFrame:
    """Caches of which all objects are in use: bytes (objects times size), their share of memory, and whether it is large."""
    used = slab.where("active = total AND total > 0").withColumn("bytes", F.col("total") * F.col("size"))
    part = (F.col("bytes") / F.lit(float(memory_bytes))).alias("memory_share")
    return used.select("report", "cache", "total", "size", "bytes", part).withColumn("suspect", F.col("memory_share") >= share)


def non_empty(slab: DataFrame) -> DataFrame:
    """Slab caches with objects."""
    return slab.where("objs > 0")


def in_state(tasks: DataFrame, *states: str) -> DataFrame:
    """Tasks of a process list in one of these states (UN: blocked)."""
    return tasks.where(F.col("st").isin(*states))


def leak_time(slab: DataFrame, objects_per_second: float) -> DataFrame:
    """How long the suspects' objects took to leak at a rate: report, cache, total, bytes, seconds and bytes_per_day."""
    seconds = (F.col("total") / F.lit(float(objects_per_second))).alias("seconds")
    per_day = (F.col("size") * F.lit(86_400.0 * objects_per_second)).alias("bytes_per_day")
    return slab.where("active = total AND total > 0").select("report", "cache", "total", (F.col("total") * F.col("size")).alias("bytes"), seconds, per_day)


def cause_of_dump(column: str = "text") -> Column:
    """manual for a dump that was asked for, fault for an oops, else null."""
    return F.when(F.col(column).rlike(r"(?i)sysrq|kdump"), "manual").when(F.col(column).rlike(r"Oops|NULL pointer|general protection"), "fault")


def phase(lines: DataFrame) -> DataFrame:
    """Where to look first in each report: memory, lock, interrupt, filesystem, driver or unknown."""
    has = lambda p: F.bool_or(like("text", p))
    flags = lines.groupBy("report").agg(has("out of memory|oom-killer").alias("memory"), has("blocked for more than|hung task|deadlock").alias("lock"), has("lockup|irq \\d+: nobody cared").alias("interrupt"), has("ext4-fs error|xfs.*error|i/o error").alias("filesystem"), has("firmware|timeout waiting").alias("driver"))
    found = F.when(F.col("memory"), "memory")
    for name in ("lock", "interrupt", "filesystem", "driver"):
        found = found.when(F.col(name), name)
    return flags.select("report", found.otherwise("unknown").alias("phase"))


def commands_for(symptom: str) -> list[str]:
    """Commands that show most on a symptom."""
    return [c for s, c in COMMANDS if s == symptom]


def commands(phases: DataFrame) -> DataFrame:
    """The commands for each report by its phase: report, phase, command; locks hang, all but memory else are slow."""
    symptom = F.when(F.col("phase") == "memory", "memory").when(F.col("phase") == "lock", "hang").otherwise("slow")
    known = phases.sparkSession.createDataFrame(list(COMMANDS), "symptom string, command string")
    return phases.withColumn("symptom", symptom).join(F.broadcast(known), "symptom").select("report", "phase", "command")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted: side (< or >) and the columns."""
    return left.exceptAll(right).select(F.lit("<").alias("side"), "*").union(right.exceptAll(left).select(F.lit(">").alias("side"), "*"))
