"""Writers and admin helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Entries that the collector retains.
RETAINED = 10_000


def retained(entries: DataFrame, n: int = RETAINED, order: str = "seq") -> DataFrame:
    """The last ``n`` entries by ``order``; Spark keeps ``n`` rows per task before it merges."""
    return entries.orderBy(F.desc(order)).limit(n)


def append_entries(entries: DataFrame, path: str) -> None:
    """Append to the table of entries; ``retained`` is the view the ring buffer gave."""
    entries.write.mode("append").parquet(path)


def write_registry(servers: DataFrame, path: str) -> None:
    """Replace the registry."""
    servers.select("sid", "type", "instance", "status").write.mode("overwrite").json(path)


def write_log_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Append lines as text."""
    lines.select(F.col(column).alias("value")).write.mode("append").text(path)


def write_json_document(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def remove(spark: SparkSession, *paths: str) -> int:
    """Delete paths; returns how many were there."""
    n = 0
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
    return n


def start_console(stream: DataFrame, rows: int = 20) -> StreamingQuery:
    """Print each micro-batch."""
    return stream.writeStream.format("console").option("numRows", rows).option("truncate", False).start()
