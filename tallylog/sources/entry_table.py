"""The table of collected entries: arrival numbers across batches, the last entries without reading the others, compaction, retention.

Entries lie in segments, folders of Parquet files with the arrival number ``seq``.  A commit log (``commits.py``) has the least and greatest number of each
segment, so a batch's numbers go on from the running total of those before it, also after a restart; a batch that is given again, as a stream does after a
failure, is found by its id and not stored twice.  Reading the last n entries opens the segments that hold them, and no others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.functions.tables import written
from tallylog.sources.commits import CommitLog, Conflict
from tallylog.sources.sinks import RETAINED


class EntryTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def segments(self) -> list[dict]:
        """Commits of the segments in force, by their numbers of entries."""
        entries = self.log.entries()
        gone = {n for e in entries for n in e.get("replaces", [])}
        return sorted((e for e in entries if e["number"] not in gone and e.get("rows")), key=lambda e: e["first"])

    def append(self, entries: DataFrame, order: list[str], batch: str | int | None = None) -> int:
        """Store a batch, numbered in ``order`` after all before it; returns its number of entries, 0 if ``batch`` was stored before.

        Entries that ``order`` does not tell apart are numbered in any order.
        """
        # sorted ranges are counted, so a large batch is numbered in parallel
        placed = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__block", F.spark_partition_id())
        placed = written(placed.withColumn("__at", F.monotonically_increasing_id()), "batch")
        sizes = placed.groupBy("__block").agg(F.count("*").alias("__n"))
        before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
        offsets = sizes.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        within = F.row_number().over(Window.partitionBy("__block").orderBy("__at")) - 1
        numbered = placed.withColumn("__within", within).join(offsets, "__block").withColumn("__place", F.col("__before") + F.col("__within"))
        numbered = numbered.select(*entries.columns, "__place")
        rows = placed.count()
        while True:
            found = self.log.entries()
            if batch is not None and any(e.get("batch") == str(batch) for e in found):
                return 0
            first = max((e["last"] + 1 for e in found if "last" in e), default=0)
            number = max((e["number"] + 1 for e in found), default=0)
            entry = {"rows": rows, "first": first, "last": first + rows - 1, "batch": None if batch is None else str(batch)}
            if rows:
                entry["data"] = f"{self.path}/segments/{uuid.uuid4().hex}"
                numbered.withColumn("seq", F.col("__place") + first).drop("__place").write.parquet(entry["data"])
            try:
                self.log.add(number, **entry)
                return rows
            except Conflict:  # another writer was first: its entries come before
                if rows:
                    self.log.remove(entry["data"])

    def read(self, first: int = 0) -> DataFrame | None:
        """Entries numbered ``first`` or more, from the segments that have such; None where there are none."""
        data = [e["data"] for e in self.segments() if e["last"] >= first]
        return self.spark.read.parquet(*data).where(F.col("seq") >= first) if data else None

    def tail(self, n: int = RETAINED) -> DataFrame | None:
        """The last ``n`` entries."""
        return self.read(max(0, self.total() - n))

    def total(self) -> int:
        """Entries that were ever stored."""
        return max((e["last"] + 1 for e in self.log.entries() if "last" in e), default=0)

    def compact(self, least_rows: int) -> int:
        """Join neighbouring segments until each has ``least_rows`` entries; returns how many went."""
        went, run = 0, []
        for segment in self.segments():
            run.append(segment)
            if sum(e["rows"] for e in run) >= least_rows:
                went += self._joined(run)
                run = []
        return went + self._joined(run)

    def _joined(self, run: list[dict]) -> int:
        if len(run) < 2:
            return 0
        data = f"{self.path}/segments/{uuid.uuid4().hex}"
        rows = self.spark.read.parquet(*[e["data"] for e in run])
        rows.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(data)
        self._replace(run, rows=sum(e["rows"] for e in run), first=run[0]["first"], last=run[-1]["last"], data=data)
        return len(run)

    def drop_all_but(self, n: int = RETAINED) -> int:
        """Remove the segments that hold none of the last ``n`` entries; returns how many went."""
        old = [e for e in self.segments() if e["last"] < self.total() - n]
        if old:
            self._replace(old)
        return len(old)

    def _replace(self, old: list[dict], **entry) -> None:
        """Commit an entry instead of others, unless one of them is replaced meanwhile, and delete their data."""
        while True:
            found = self.log.entries()
            gone = {n for e in found for n in e.get("replaces", [])}
            if any(e["number"] in gone for e in old):
                if "data" in entry:
                    self.log.remove(entry["data"])
                raise Conflict("segments were replaced by another writer")
            try:
                self.log.add(found[-1]["number"] + 1, replaces=[e["number"] for e in old], **entry)
                break
            except Conflict:
                continue
        self.log.remove(*[e["data"] for e in old])


def start_entries(stream: DataFrame, table: EntryTable, order: list[str], checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Store a stream's batches; a batch repeated after a restart is stored once."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: table.append(rows, order, batch) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
