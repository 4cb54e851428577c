"""Neighbours, running sums and last known values in an order, without one task per key.

A window function over a whole key puts all its rows into one task, and a trace has few CPUs. Here windows run within
buckets of the order column (a whole number, such as a time), and what crosses a bucket's edge comes from a table with a
row for each key and bucket that has rows. Results are those of the plain window, whatever the width.

Both the windows and the edges read the rows. So a function stores what it gets first, unless that is Parquet with narrow
steps only: the first link of a chain over stored events stores nothing, each further one its input once, and plans don't
double with each link. Rows are shuffled once, by key and bucket; the edges are summed before their shuffle, and the join
finds the rows dealt as it needs them. last_known() deals them into more tasks the more rows there are: Spark's number of
shuffle partitions is fixed, and a task would sort a share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import kept_once

_BUCKET, _KEY = "__bucket", "__key"
#: Rows that a task sorts for last_known(), on the average.
SORTED = 250_000


def _bucketed(frame: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """frame, at hand or stored, with its key as one value (a struct, in which nulls are alike) and its bucket."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return kept_once(frame, "ordered").withColumns({_KEY: key, _BUCKET: F.floor(F.col(at) / F.lit(width))})


def _dealt(frame: DataFrame) -> DataFrame:
    """frame of _bucketed() by key and bucket, in tasks of SORTED rows where shuffle partitions would hold more."""
    tasks = -(-frame.count() // SORTED)
    return frame.repartition(tasks, _KEY, _BUCKET) if tasks > int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) else frame


def _inner(at: str, ties: list[str]):
    return Window.partitionBy(_KEY, _BUCKET).orderBy(at, *ties)


def _edges():
    """The edges of a key in their order."""
    return Window.partitionBy(_KEY).orderBy(_BUCKET)


def _before():
    """The edges before each."""
    return _edges().rowsBetween(Window.unboundedPreceding, -1)


def neighbour(frame: DataFrame, by: list[str], at: str, ties: list[str], columns: list[str], name: str, width: int, step: int = 1) -> DataFrame:
    """Adds name, a struct of columns of the next row (step 1) or the row before (step -1) of the same key; else null."""
    frame = _bucketed(frame, by, at, width)
    value, place = F.struct(*columns), F.struct(at, *ties)
    edges = frame.groupBy(_KEY, _BUCKET).agg((F.min_by(value, place) if step > 0 else F.max_by(value, place)).alias("__edge"))
    edges = edges.withColumn("__carry", F.lead("__edge", step).over(_edges())).drop("__edge")
    found = frame.withColumn("__own", F.lead(value, step).over(_inner(at, ties))).join(edges, [_KEY, _BUCKET], "left")
    return found.withColumn(name, F.coalesce("__own", "__carry")).drop("__own", "__carry", _BUCKET, _KEY)


def running_height(frame: DataFrame, by: list[str], at: str, ties: list[str], step: Column, name: str, width: int) -> DataFrame:
    """Adds the height of a stack before each row (name) and whether the row is a pop of an empty stack (name_lost).

    step is 1 for a push and -1 for a pop; pops of an empty stack are ignored. With the running sum S the height is
    S - min(0, least S so far).
    """
    frame = _bucketed(frame.withColumn("__step", step), by, at, width)
    inner = _inner(at, ties)
    found = frame.withColumn("__sum", F.sum("__step").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    edges = found.groupBy(_KEY, _BUCKET).agg(F.sum("__step").alias("__all"), F.min("__sum").alias("__least"))
    edges = edges.withColumn("__from", F.coalesce(F.sum("__all").over(_before()), F.lit(0)))
    edges = edges.withColumn("__floor", F.least(F.lit(0), F.min(F.col("__from") + F.col("__least")).over(_before()))).drop("__all", "__least")
    found = found.withColumn("__low", F.min("__sum").over(inner.rowsBetween(Window.unboundedPreceding, -1))).join(edges, [_KEY, _BUCKET], "left")
    low = F.least(F.col("__floor"), F.col("__from") + F.col("__low"))
    found = found.withColumn(name, F.col("__from") + F.col("__sum") - F.col("__step") - low)
    return found.withColumn(f"{name}_lost", (F.col("__step") < 0) & (F.col(name) == 0)).drop("__step", "__sum", "__low", "__from", "__floor", _BUCKET, _KEY)


def running_sums(frame: DataFrame, by: list[str], at: str, ties: list[str], columns: list[str], width: int, last: Column | None = None) -> DataFrame:
    """Replaces whole-number columns by their sums over the rows before each of the same key, without itself.

    last, if given, adds the column last: its last value that isn't null among those rows.
    """
    frame = _bucketed(frame if last is None else frame.withColumn("__last", last), by, at, width)
    inner = _inner(at, ties).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(c).alias(f"__all_{c}") for c in columns]
    if last is not None:
        totals.append(F.max_by("__last", F.when(F.col("__last").isNotNull(), F.struct(at, *ties))).alias("__edge"))
    edges = frame.groupBy(_KEY, _BUCKET).agg(*totals)
    carried = [F.sum(f"__all_{c}").over(_before()).alias(f"__from_{c}") for c in columns]
    if last is not None:
        carried.append(F.last("__edge", ignorenulls=True).over(_before()).alias("__carry"))
    edges = edges.select(_KEY, _BUCKET, *carried)
    own = {f"__own_{c}": F.sum(c).over(inner) for c in columns} | ({} if last is None else {"__own": F.last("__last", ignorenulls=True).over(inner)})
    found = frame.withColumns(own).join(edges, [_KEY, _BUCKET], "left")
    found = found.withColumns({c: F.coalesce(f"__own_{c}", F.lit(0)) + F.coalesce(f"__from_{c}", F.lit(0)) for c in columns})
    if last is not None:
        found = found.withColumn("last", F.coalesce("__own", "__carry"))
    return found.drop(*[f"__{p}_{c}" for p in ("own", "from") for c in columns], "__own", "__carry", "__last", _BUCKET, _KEY)


def last_known(frame: DataFrame, by: list[str], at: str, ties: list[str], value: Column, name: str, width: int, earlier: bool = False) -> DataFrame:
    """Adds the last value that isn't null of the same key, up to and with each row, or (earlier) of rows with a lesser at."""
    frame = _bucketed(frame.withColumn("__value", value), by, at, width)
    dealt = _dealt(frame)
    inner = _inner(at, ties).rowsBetween(Window.unboundedPreceding, 0)
    edges = frame.groupBy(_KEY, _BUCKET).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(at, *ties))).alias("__edge"))
    edges = edges.withColumn("__carry", F.last("__edge", ignorenulls=True).over(_before())).drop("__edge")
    own = F.last("__value", ignorenulls=True).over(inner)
    if earlier:
        placed = F.when(F.col("__value").isNotNull(), F.struct(at, *ties, "__value"))
        own = F.max(placed).over(Window.partitionBy(_KEY, _BUCKET).orderBy(at).rangeBetween(Window.unboundedPreceding, -1))["__value"]
    found = dealt.withColumn("__own", own).join(edges, [_KEY, _BUCKET], "left")
    return found.withColumn(name, F.coalesce("__own", "__carry")).drop("__own", "__carry", "__value", _BUCKET, _KEY)
