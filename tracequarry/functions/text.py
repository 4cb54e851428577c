"""Column functions over names and texts of traces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the frequency report calls the states and how busy a CPU is.
STATES = {"R": "运行/可运行", "S": "可中断睡眠", "D": "不可中断睡眠(I/O等待)", "T": "停止", "Z": "僵尸", "I": "空闲", "X": "退出"}
UNKNOWN_STATE = "未知状态"
BUSY = ((20, "非常繁忙"), (15, "繁忙"), (10, "中等"))
IDLE_LEVEL = "较空闲"
VIRTUALISATION = ("kvm", "qemu", "vhost")

#: Kinds of processes by name; pid 0 is idle whatever its name.
KINDS = (
    ("idle", r"^(swapper/?|<idle>)"),
    ("softirq", r"^ksoftirqd/"),
    ("irq", r"^irq/"),
    ("kernel_thread", r"^(kworker|kswapd|migration/|rcu|kthreadd|watchdog|khugepaged|jbd2/)"),
)


def glob_pattern(pattern: str) -> str:
    """A shell pattern of *, ? and [sets] as a regular expression for a whole text."""
    parts = re.findall(r"\*|\?|\[\^?\]?[^\]]*\]|.", pattern, re.S)
    made = "".join(".*" if p == "*" else "." if p == "?" else p.replace("\\", "\\\\") if len(p) > 1 else re.escape(p) for p in parts)
    return f"(?s)^{made}$"


def glob(column: Column | str, pattern: str) -> Column:
    """Whether a text matches a case-sensitive shell pattern of *, ? and [sets]."""
    return (F.col(column) if isinstance(column, str) else column).rlike(glob_pattern(pattern))


def process_type(comm: Column | str, pid: Column | str) -> Column:
    """idle, softirq, irq, kernel_thread or user."""
    comm, pid = (F.col(c) if isinstance(c, str) else c for c in (comm, pid))
    found = F.when(pid == 0, "idle")
    for kind, pattern in KINDS:
        found = found.when(comm.rlike(pattern), kind)
    return found.otherwise("user")


def state_text(state: Column | str) -> Column:
    """What a state's letter stands for."""
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(table[F.col(state) if isinstance(state, str) else state], F.lit(UNKNOWN_STATE))


def busy_level(percent: Column) -> Column:
    """How busy a CPU with this share of all events is."""
    found = F.when(percent > BUSY[0][0], BUSY[0][1])
    for least, name in BUSY[1:]:
        found = found.when(percent > least, name)
    return found.otherwise(IDLE_LEVEL)


def size_value(column: Column | str) -> Column:
    """The number of a size such as 1.2M, 100K or 42B; without a number, null. Suffixes are decimal."""
    text = F.col(column) if isinstance(column, str) else column
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*[BKMGbkmg]?", 1).try_cast("decimal(20,4)")
    suffix = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([BKMGbkmg]?)", 1))
    scale = F.when(suffix == "K", 1_000).when(suffix == "M", 1_000_000).when(suffix == "G", 1_000_000_000).otherwise(1)
    return F.round(number * scale).cast("long")
