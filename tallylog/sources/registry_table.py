"""The registry of servers as a table that only grows, with create-if-absent.

A registration writes its new servers beside the others and takes the next number of a commit log.  Who finds the number taken reads again, so of two
that register one server at once the second gets the first one's SID.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.tables import written
from tallylog.operators.registry import make_sid
from tallylog.sources.commits import CommitLog, Conflict
from tallylog.sources.logs import SERVERS

#: Fixed value: the status of a new server.
REGISTERED = "registered"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)

    def _read(self, entries: list[dict]) -> DataFrame:
        data = [e["data"] for e in entries]
        return self.spark.read.schema(SERVERS).parquet(*data) if data else self.spark.createDataFrame([], SERVERS)

    def read(self) -> DataFrame:
        """sid, type, instance, status of all servers."""
        return self._read(self.log.entries())

    def create(self, wanted: DataFrame) -> DataFrame:
        """The registry's rows of ``wanted`` (type, instance, seed), of which those that were absent are registered first.

        Of rows of one type and instance that with the smallest seed gives the SID.  Rows without a type or an instance are left out.
        """
        asked = wanted.where("type is not null and instance is not null")
        asked = written(asked.groupBy("type", "instance").agg(F.min(F.col("seed").cast("string")).alias("seed")), "wanted")
        while True:
            entries = self.log.entries()
            absent = asked.join(self._read(entries), ["type", "instance"], "left_anti")
            sid = make_sid(F.coalesce("seed", F.lit("")), F.col("type"), F.col("instance"))
            new = absent.select(sid.alias("sid"), "type", F.col("instance").cast("int").alias("instance"), F.lit(REGISTERED).alias("status"))
            data = f"{self.path}/servers/{uuid.uuid4().hex}"
            new.write.parquet(data)
            if not self.spark.read.schema(SERVERS).parquet(data).limit(1).count():
                self.log.remove(data)
                break
            try:
                self.log.add(len(entries), data=data)
                break
            except Conflict:  # another writer was first: what it registered is no longer absent
                self.log.remove(data)
        return self.read().join(asked.select("type", "instance"), ["type", "instance"]).select("sid", "type", "instance", "status")
