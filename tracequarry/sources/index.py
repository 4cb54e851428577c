"""An index of a trace: its events stored in batches, and small tables that answer without reading them.

A batch is what was indexed at once. The list of files that batches come from is written last, and only listed batches are
read, so a build that broke off leaves nothing behind that counts. A file that is new becomes a batch of its own; where a
file changed or went, all is indexed anew.

A batch lies in folders of time: of a minute each, or of 2, 4, 8 minutes and so on where these would be too many. ts_part is
the first minute of a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Nanoseconds of a partition of stored events.
PARTITION_NS = 60 * 10**9
#: Folders of time that a batch has at most.
FOLDERS = 1_000
#: Partitions up to which a query names those that hold a pid.
NAMED = 10_000


def width_of(first: int | None, last: int | None) -> int:
    """Minutes of a folder of events from a time to another, a power of two."""
    width = 1
    while first is not None and last // (width * PARTITION_NS) - first // (width * PARTITION_NS) >= FOLDERS:
        width *= 2
    return width


class Index:
    """The folder of an index; paths are any that Spark's file systems open."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def there(self, path: str) -> bool:
        place, system = self._place(path)
        return system.exists(place)

    def listed(self, path: str) -> dict[str, tuple[int, int]]:
        """Length and time of change of each file of a path, of its folders too, but for hidden ones."""
        place, system = self._place(path)
        found: dict[str, tuple[int, int]] = {}
        for top in system.globStatus(place) or []:
            files = system.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                inner = f.getPath().toString()[len(top.getPath().toString()) :].split("/")
                if not any(x.startswith(("_", ".")) for x in inner if x):
                    found[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
        return found

    def part(self, path: str, start: int, length: int) -> bytes:
        """So many bytes of a file from a place on, or what there is."""
        place, system = self._place(path)
        length = min(length, system.getFileStatus(place).getLen() - start)
        if length <= 0:
            return b""
        stream = system.open(place)
        try:
            stream.seek(start)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def _table(self, name: str) -> DataFrame:
        """A side table, of the batches that count."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch").isin(self.batches()))

    def _listing(self) -> list | None:
        if not self.there(f"{self.path}/_files/_SUCCESS"):
            return None
        return self.spark.read.parquet(f"{self.path}/_files").collect()

    def files(self) -> dict[str, tuple[int, int]] | None:
        """The files that are indexed, as listed() had them; none without an index."""
        rows = self._listing()
        return None if rows is None else {r["file"]: (r["length"], r["changed"]) for r in rows}

    def batches(self) -> list[str]:
        return sorted({r["batch"] for r in self._listing() or ()})

    def _schema(self) -> StructType:
        """The columns of events and ts_part, whose metadata have the width of the widest folders (none: a minute)."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/_schema").first()[0]))
        return schema if "ts_part" in schema.names else schema.add("ts_part", LongType())

    def events(self) -> DataFrame:
        """Events of all batches, with ts_part; its metadata have the width of the widest folders if they aren't of a minute."""
        paths = [f"{self.path}/batch={b}" for b in self.batches()]
        schema = self._schema()
        said = schema["ts_part"].metadata
        found = self.spark.read.schema(schema.add("batch", "string")).option("basePath", self.path).parquet(*paths).drop("batch")
        return found.withMetadata("ts_part", said) if said.get("width", 1) > 1 else found

    def update(self, trace: str, parse: Callable[[list[str]], DataFrame], write: Callable[..., None], force: bool = False) -> int:
        """Indexes the files of a trace that aren't; returns how many were read.

        The text is parsed once, into a folder that goes at the end: how long the trace is, what ranges it is dealt out in,
        and the events themselves are three readings.
        """
        now, known = self.listed(trace), self.files()
        if force or known is None or any(now.get(f) != x for f, x in known.items()):
            place, system = self._place(self.path)
            system.delete(place, True)
            known = {}
        fresh = sorted(set(now) - set(known))
        if not fresh:
            return 0
        batch = uuid.uuid4().hex
        parsed, events = f"{self.path}/_parsed-{batch}", parse(fresh)
        events.write.parquet(parsed)
        events = self.spark.read.schema(events.schema).parquet(parsed)
        width = width_of(*events.agg(F.min("ts"), F.max("ts")).first())
        write(events, f"{self.path}/batch={batch}", width=width)
        widest = max(width, self._schema()["ts_part"].metadata.get("width", 1) if known else 1)
        schema = StructType([*events.schema.fields]).add("ts_part", LongType(), metadata={"width": widest})
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/batch={batch}")
        name = F.lit(batch).alias("batch")
        pids = F.explode(F.array_distinct(F.array("pid", "prev_pid", "next_pid")))
        seen = stored.select("ts_part", F.col("pid").alias("__own"), pids.alias("pid")).where("pid IS NOT NULL").groupBy("pid", "ts_part").agg(F.max(F.col("pid") == F.col("__own")).alias("own"))
        seen.select("pid", "ts_part", "own", name).repartitionByRange("pid").sortWithinPartitions("pid").write.mode("append").parquet(f"{self.path}/_pids")
        totals = stored.groupBy("ts_part", "event", "cpu").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        totals.select("*", name).write.mode("append").parquet(f"{self.path}/_totals")
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_schema")
        rows = [(batch, f, *now[f]) for f in fresh]
        self.spark.createDataFrame(rows, "batch string, file string, length long, changed long").coalesce(1).write.mode("append").parquet(f"{self.path}/_files")
        place, system = self._place(parsed)
        system.delete(place, True)
        return len(fresh)

    def totals(self) -> DataFrame:
        """events, first and last time by ts_part, event and cpu."""
        return self._table("_totals").drop("batch")

    def pids(self) -> DataFrame:
        """pid, ts_part and own: where a pid occurs, and whether as the one of a line's head."""
        return self._table("_pids").drop("batch")

    def parts_of(self, pids: tuple[int, ...]) -> list[int] | None:
        """Partitions of time in which one of the pids occurs; none if they are too many to name."""
        found = self.pids().where(F.col("pid").isin(*pids)).select("ts_part").distinct().limit(NAMED + 1).collect()
        return None if len(found) > NAMED else sorted(r[0] for r in found)

    def write_one(self, ordered: DataFrame) -> None:
        """Writes rows in their order as one text file at the path."""
        made = f"{self.path}.{uuid.uuid4().hex}"
        ordered.coalesce(1).write.text(made)
        part = next(f for f in self.listed(made) if "/part-" in f)
        (source, system), target = self._place(part), self._place(self.path)[0]
        system.delete(target, True)
        system.rename(source, target)
        system.delete(self._place(made)[0], True)
