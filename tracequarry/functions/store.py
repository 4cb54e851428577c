"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What kept() has written in this process: session and path.
_WRITTEN: list[tuple[SparkSession, str]] = []
#: Steps of a plan that move no rows between tasks, and rows dealt out anew, which Spark does once for equal plans.
_NARROW = {"Project", "Filter", "Generate", "Union", "Relation", "LocalRelation", "Range", "RepartitionByExpression"}


def shared_folder(spark: SparkSession) -> str:
    """What setCheckpointDir() or spark.checkpoint.dir name; where both are unset and the master is local, one under /tmp.

    On a cluster there is no folder that every executor is known to see, so there an unset one is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file:///tmp/tracequarry-{uuid.uuid4().hex}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def kept(frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again; clear(), or the end of the process, deletes it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def at_hand(frame: DataFrame) -> bool:
    """Whether a frame is Parquet with narrow steps only, or dealt out once, so that reading it twice costs less than storing it."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"monotonically_increasing_id|\brandn?\(|\buuid\(", plan):
        return False  # the two readings would differ
    steps = [re.sub(r"^[\s:+|-]*", "", line) for line in plan.splitlines()]
    steps = [s for s in steps if s]
    return all(re.match(r"\w+", s) and re.match(r"\w+", s)[0] in _NARROW and (not s.startswith("Relation") or s.endswith("parquet")) for s in steps)


def kept_once(frame: DataFrame, name: str) -> DataFrame:
    """kept(), but for a frame that is at hand already."""
    return frame if at_hand(frame) else kept(frame, name)


def clear() -> None:
    """Deletes what kept() has written; frames that read it can't be used any more."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear_at_exit() -> None:
    with contextlib.suppress(Exception):  # the session's process may be gone
        clear()
