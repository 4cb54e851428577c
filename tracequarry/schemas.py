"""Columns of the trace tables; times are nanoseconds in BIGINT, and a duration that has no end is null."""

from __future__ import annotations

RAW_EVENT = """task STRING, pid BIGINT, cpu INT, flags STRING, ts BIGINT, ts_sec DECIMAL(20,9), event STRING, message STRING,
prev_comm STRING, prev_pid BIGINT, prev_prio INT, prev_state STRING, next_comm STRING, next_pid BIGINT, next_prio INT,
wake_comm STRING, wake_pid BIGINT"""

TABLES: dict[str, str] = {
    "sched": "id BIGINT, ts BIGINT, dur BIGINT, cpu BIGINT, utid BIGINT, end_state STRING, priority BIGINT, ucpu BIGINT, ts_end BIGINT",
    "thread_state": "id BIGINT, ts BIGINT, dur BIGINT, utid BIGINT, state STRING, io_wait BOOLEAN, blocked_function STRING, waker_utid BIGINT, waker_id BIGINT, irq_context BOOLEAN, ucpu BIGINT",
    "thread": "id BIGINT, utid BIGINT, tid BIGINT, name STRING, start_ts BIGINT, end_ts BIGINT, upid BIGINT, is_main_thread BOOLEAN, is_idle BOOLEAN, machine_id BIGINT",
    "process": "upid BIGINT, pid BIGINT, name STRING, start_ts BIGINT, end_ts BIGINT, parent_upid BIGINT, uid BIGINT, android_appid BIGINT, android_user_id BIGINT, cmdline STRING, arg_set_id BIGINT, machine_id BIGINT",
    "slice": "id BIGINT, ts BIGINT, dur BIGINT, track_id BIGINT, category STRING, name STRING, depth BIGINT, parent_id BIGINT, arg_set_id BIGINT, thread_ts BIGINT, thread_dur BIGINT, thread_instruction_count BIGINT, thread_instruction_delta BIGINT",
    "track": "id BIGINT, name STRING, parent_id BIGINT, type STRING, event_type STRING, utid BIGINT, upid BIGINT, source_arg_set_id BIGINT, dimension_arg_set_id BIGINT",
    "counter": "id BIGINT, ts BIGINT, track_id BIGINT, value DOUBLE, arg_set_id BIGINT",
    "counter_track": "id BIGINT, name STRING, parent_id BIGINT, type STRING, unit STRING, description STRING, source_arg_set_id BIGINT, machine_id BIGINT, dimension_arg_set_id BIGINT",
    "sched_latency_for_running_interval": "thread_state_id BIGINT, sched_id BIGINT, utid BIGINT, runnable_latency_id BIGINT, latency_dur BIGINT",
    "linux_hard_irqs": "ts BIGINT, dur BIGINT, name STRING, id BIGINT, parent_id BIGINT",
    "linux_soft_irqs": "ts BIGINT, dur BIGINT, name STRING, id BIGINT",
    "_slice_flattened": "slice_id BIGINT, ts BIGINT, dur BIGINT, depth BIGINT, name STRING, root_id BIGINT, track_id BIGINT, utid BIGINT, tid BIGINT, thread_name STRING, upid BIGINT, pid BIGINT, process_name STRING",
}


def columns(table: str) -> list[tuple[str, str]]:
    """Names and types of a table's columns."""
    return [tuple(c.split()) for c in TABLES[table].split(", ")]
