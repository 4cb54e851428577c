"""Kernel-trace and crash-log analytics expressed as Spark DataFrame and SQL jobs."""
