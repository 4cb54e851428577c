"""Crash reports as text: sections by command, and the tables that some sections hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import last_known
from ..functions.store import kept
from ..functions.text import size_value
from .ftrace import read_lines

#: Lines of a window's bucket.
LINES = 100_000

# The marks of a section and the forms of the lines in it.
COMMAND = r"^>>> Command: (.*)$"
PS = r"^>?\s*(\d+)\s+(\d+)\s+(\d+)\s+([0-9a-f]+)\s+([A-Z]{2})\s+([0-9.]+)\s+(\d+)\s+(\d+)\s+(.*)$"
SLAB = r"^(\S+)\s+([0-9.]+[KMG]?)\s+([0-9.]+[KMG]?)\s+([0-9.]+[KMG]?)\s+([0-9.]+[BKMG]?)"
LOG = r"^\[\s*(\d+\.\d+)\]\s?(.*)$"
FRAME = r"^\s*#(\d+)\s+(?:\[[0-9a-f]+\]\s+)?([A-Za-z_][\w.]*)(?:\(\))?(?:\+(0x[0-9a-f]+|\d+))?"
TASK = r"^PID:\s+(\d+)"
MEMORY = r"^\s*([A-Z][A-Z ]*?):?\s{1,}([0-9.]+)\s*([KMG]?B?)"
SYSTEM = r"^\s*([A-Z]+): (.*)$"
IRQ = r"^\s*(\d+):\s+((?:\d+\s+)+)(\S+)\s+(.+)$"
TIMER = r"^\s*(\d+)\s+([0-9a-f]{8,16})\s+([0-9a-f]{8,16})\s+<(\S+)>"
MODULE = r"^([0-9a-f]{16})\s+(\S+)\s+(\d+)\s+(.*)$"
WAITER = r"^PID:\s+(\d+)\s+TASK:\s+([0-9a-f]+)"
WAITED = r"^waitq\s+([0-9a-f]+)"
LOCKED = r"^struct\s+mutex\s+([0-9a-f]+)"
FILES, MOUNTS, DEVICES, QUEUES = r"^(foreach\b.*\s)?files\b", r"^mount\b", r"^dev\b", r"^runq\b"
FILE = r"^\s*(\d+)\s+([0-9a-f]{8,16})\s+([0-9a-f]{8,16})\s+([0-9a-f]{8,16})\s+([A-Z?]+)\s*(.*?)\s*$"
MOUNT = r"^\s*([0-9a-f]{8,16})\s+([0-9a-f]{8,16})\s+(\S+)\s+(\S+)\s+(\S.*?)\s*$"
DEVICE = r"^\s*(\d+)\s+(\S.*?)\s+([0-9a-f]{8,16}|\(none\))(?:\s+(\S+))?\s*$"
DEVICE_KIND = r"^(CHRDEV|BLKDEV)\s+NAME\b"
QUEUE, QUEUE_KIND = r"^\s*CPU\s+(\d+)\s+RUNQUEUE:\s*([0-9a-f]+)", r"^\s*(CURRENT|RT|CFS)\b"
QUEUED = r"^\s*(?:CURRENT:\s*)?(?:\[\s*(\d+)\]\s*)?PID:\s*(\d+)\s+TASK:\s*([0-9a-f]+)\s+.*COMMAND:\s*\"(.*)\"\s*$"
OWNER = r"^\s*owner\s*=\s*(?:\(struct task_struct \*\)\s*)?0x([0-9a-f]+)"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report, line_no (from 0) and text of crash reports, one file each.

    A file is read in splits like any text. A line's number is its place in the split and the lines of the splits before,
    so a report of any length is many tasks.
    """
    lines = kept(read_lines(spark, path), "report-lines").select("value", "place.*")
    file, split = ["file_path"], ["file_path", "file_block_start"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*file).orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = lines.groupBy(*split).agg(F.count("*").alias("n")).select(*split, before.alias("before"))
    numbered = lines.withColumn("nth", F.row_number().over(Window.partitionBy(*split).orderBy("row"))).join(offsets, split)
    return numbered.select(F.element_at(F.split("file_path", "/"), -1).alias("report"), (F.col("before") + F.col("nth") - 1).cast("long").alias("line_no"), F.col("value").alias("text"))


def _last(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null up to each line of its report; reports of any length, in buckets of lines."""
    return last_known(lines, ["report"], "line_no", [], value, name, LINES)


def sections(lines: DataFrame) -> DataFrame:
    """Lines of reports with the section they stand in (null before the first) and the line at which it begins."""
    command = F.nullif(F.regexp_extract("text", COMMAND, 1), F.lit(""))
    found = _last(lines, F.when(command.isNotNull(), F.struct(command.alias("section"), F.col("line_no").alias("section_line"))), "of")
    return found.select("report", "of.section", "of.section_line", "line_no", "text")


def _parts(pattern: str, names: dict[str, tuple[int, str]]) -> list[Column]:
    return [F.nullif(F.regexp_extract("text", pattern, g), F.lit("")).try_cast(t).alias(n) for n, (g, t) in names.items()]


def ps(lines: DataFrame) -> DataFrame:
    """Tasks of process lists."""
    names = {"pid": (1, "long"), "ppid": (2, "long"), "cpu": (3, "int"), "task": (4, "string"), "st": (5, "string"), "mem": (6, "double"), "vsz": (7, "long"), "rss": (8, "long"), "comm": (9, "string")}
    return lines.where(F.col("text").rlike(PS)).select("report", "line_no", *_parts(PS, names))


def slab(lines: DataFrame) -> DataFrame:
    """Slab caches, sizes and counts as numbers."""
    found = lines.where(F.col("text").rlike(SLAB) & ~F.col("text").rlike(r"^CACHE\s"))
    return found.select("report", "line_no", F.regexp_extract("text", SLAB, 1).alias("cache"), *[size_value(F.regexp_extract("text", SLAB, g)).alias(n) for g, n in ((2, "objs"), (3, "active"), (4, "total"), (5, "size"))])


def log(lines: DataFrame) -> DataFrame:
    """Kernel log lines: ts_sec and msg."""
    return lines.where(F.col("text").rlike(LOG)).select("report", "line_no", *_parts(LOG, {"ts_sec": (1, "decimal(20,6)"), "msg": (2, "string")}))


def frames(lines: DataFrame) -> DataFrame:
    """Stack frames with the pid that stands above them in the report."""
    owned = _last(lines, F.nullif(F.regexp_extract("text", TASK, 1), F.lit("")), "owner").withColumn("pid", F.col("owner").try_cast("long"))
    return owned.where(F.col("text").rlike(FRAME)).select("report", "line_no", "pid", *_parts(FRAME, {"idx": (1, "int"), "func": (2, "string"), "off": (3, "string")}))


def memory(lines: DataFrame) -> DataFrame:
    """Figures of memory summaries: label and bytes."""
    value = F.concat(F.regexp_extract("text", MEMORY, 2), F.regexp_extract("text", MEMORY, 3))
    return lines.where(F.col("text").rlike(MEMORY)).select("report", "line_no", F.trim(F.regexp_extract("text", MEMORY, 1)).alias("label"), size_value(value).alias("bytes"))


def system(lines: DataFrame) -> DataFrame:
    """Keys and values of system summaries."""
    return lines.where(F.col("text").rlike(SYSTEM)).select("report", "line_no", *_parts(SYSTEM, {"key": (1, "string"), "value": (2, "string")}))


def interrupts(lines: DataFrame) -> DataFrame:
    """Interrupts: number, count (over all CPUs), handler and device."""
    total = F.expr(f"aggregate(transform(split(trim(regexp_extract(text, r'{IRQ}', 2)), ' +'), x -> try_cast(x AS BIGINT)), 0L, (a, x) -> a + coalesce(x, 0L))").alias("count")
    return lines.where(F.col("text").rlike(IRQ)).select("report", "line_no", *_parts(IRQ, {"irq": (1, "int")}), total, *_parts(IRQ, {"handler": (3, "string"), "device": (4, "string")}))


def timers(lines: DataFrame) -> DataFrame:
    """Kernel timers: when they expire, their address and function."""
    return lines.where(F.col("text").rlike(TIMER)).select("report", "line_no", *_parts(TIMER, {"expires": (1, "long"), "timer": (2, "string"), "func": (4, "string")}))


def modules(lines: DataFrame) -> DataFrame:
    """Loaded modules: address, name, size and object file."""
    return lines.where(F.col("text").rlike(MODULE)).select("report", "line_no", *_parts(MODULE, {"module": (1, "string"), "name": (2, "string"), "size": (3, "long"), "file": (4, "string")}))


def wait_edges(sectioned: DataFrame) -> DataFrame:
    """Who waits for whom, from the sections of wait queues and mutexes: report, lock, task and owner (addresses).

    sectioned is what sections() returns. A lock without an owner's section has a null owner; of several owners' lines
    the last counts.
    """
    waits = sectioned.where(F.col("section").rlike(WAITED) & F.col("text").rlike(WAITER)).select("report", F.regexp_extract("section", WAITED, 1).alias("lock"), F.regexp_extract("text", WAITER, 2).alias("task"))
    owners = sectioned.where(F.col("section").rlike(LOCKED) & F.col("text").rlike(OWNER)).select("report", F.regexp_extract("section", LOCKED, 1).alias("lock"), F.regexp_extract("text", OWNER, 1).alias("owner"), "line_no")
    last = owners.groupBy("report", "lock").agg(F.max_by("owner", "line_no").alias("owner"))
    return waits.join(last, ["report", "lock"], "left").select("report", "lock", "task", "owner")


def of_tasks(sectioned: DataFrame, pattern: str) -> DataFrame:
    """The lines of the sections of a pattern with the task that they stand under: pid and task (null before the first).

    sectioned is what sections() returns; a section is a command over every task or one, each with a line that names it.
    """
    own = sectioned.where(F.col("section").rlike(pattern))
    pid = F.nullif(F.regexp_extract("text", WAITER, 1), F.lit("")).try_cast("long")
    named = F.when(pid.isNotNull(), F.struct(pid.alias("pid"), F.regexp_extract("text", WAITER, 2).alias("task")))
    found = last_known(own, ["report", "section_line"], "line_no", [], named, "of", LINES)
    return found.select("report", "section", "section_line", "line_no", "text", "of.pid", "of.task")


def open_files(sectioned: DataFrame) -> DataFrame:
    """Open files of tasks: report, line_no, pid, task, fd, file, dentry, inode, type and path (null where there is none)."""
    names = {"fd": (1, "int"), "file": (2, "string"), "dentry": (3, "string"), "inode": (4, "string"), "type": (5, "string"), "path": (6, "string")}
    found = of_tasks(sectioned, FILES).where(F.col("text").rlike(FILE))
    return found.select("report", "line_no", "pid", "task", *_parts(FILE, names))


def mounts(sectioned: DataFrame) -> DataFrame:
    """Mounted file systems: report, line_no, mount, superblock, type, device and directory."""
    names = {"mount": (1, "string"), "superblock": (2, "string"), "type": (3, "string"), "device": (4, "string"), "directory": (5, "string")}
    found = sectioned.where(F.col("section").rlike(MOUNTS) & F.col("text").rlike(MOUNT))
    return found.select("report", "line_no", *_parts(MOUNT, names))


def devices(sectioned: DataFrame) -> DataFrame:
    """Devices: report, line_no, kind (char or block, by the heading above), major, name, address (null for none) and operations."""
    own = sectioned.where(F.col("section").rlike(DEVICES))
    heading = F.nullif(F.regexp_extract("text", DEVICE_KIND, 1), F.lit(""))
    headed = last_known(own, ["report", "section_line"], "line_no", [], heading, "heading", LINES).where(F.col("text").rlike(DEVICE))
    kind = F.when(F.col("heading") == "CHRDEV", "char").when(F.col("heading") == "BLKDEV", "block").alias("kind")
    major, name, address, operations = _parts(DEVICE, {"major": (1, "int"), "name": (2, "string"), "address": (3, "string"), "operations": (4, "string")})
    found = headed.select("report", "line_no", kind, major, name, address, operations)
    return found.withColumn("address", F.nullif("address", F.lit("(none)")))


def run_queues(sectioned: DataFrame) -> DataFrame:
    """Tasks on run queues: report, line_no, cpu, queue (address), kind (current, rt or cfs), prio, pid, task and comm.

    A queue's tree is flat here: each task has the CPU and the list that it stands under.
    """
    own = sectioned.where(F.col("section").rlike(QUEUES))
    cpu, kind = F.nullif(F.regexp_extract("text", QUEUE, 1), F.lit("")).try_cast("int"), F.nullif(F.regexp_extract("text", QUEUE_KIND, 1), F.lit(""))
    under = last_known(own, ["report", "section_line"], "line_no", [], F.when(cpu.isNotNull(), F.struct(cpu.alias("cpu"), F.regexp_extract("text", QUEUE, 2).alias("queue"))), "of", LINES)
    under = last_known(under, ["report", "section_line"], "line_no", [], F.lower(kind), "kind", LINES).where(F.col("text").rlike(QUEUED))
    names = {"prio": (1, "int"), "pid": (2, "long"), "task": (3, "string"), "comm": (4, "string")}
    return under.select("report", "line_no", "of.cpu", "of.queue", "kind", *_parts(QUEUED, names))
