"""The collector as a stream: tailed lines to entries, requests to enriched records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.operators.lookup import with_sids
from tallylog.operators.parsing import collect_entries, parsed_event, rejection


def tailed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the ``*.log`` files of a folder as they are written."""
    from tallylog.streaming.tail import register

    register(spark)
    return spark.readStream.format("tail").load(folder)


def entries(lines: DataFrame, servers: DataFrame, sids: DataFrame) -> DataFrame:
    """Collected entries; ``servers`` maps log_file to server_id and ``sids`` to sid."""
    rows = lines.join(servers, "log_file", "left").withColumn("server_type", F.coalesce("server_id", F.lit("UNKNOWN")))
    return collect_entries(with_sids(rows, sids))


def start_collector(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append entries to a table, exactly once per line."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def ingest(requests: DataFrame) -> DataFrame:
    """Valid requests with id, ingested_at and parsed fields."""
    valid = requests.where(rejection(F.col("level"), F.col("service"), F.col("message"), F.col("timestamp")).isNull())
    return valid.withColumns({"id": F.uuid(), "ingested_at": F.current_timestamp(), "parsed": parsed_event(F.col("message"))})


def push(stream: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Give each micro-batch, as JSON texts, to ``sink(DataFrame, batch_id)``."""
    values = stream.select(F.to_json(F.struct("*")).alias("value"))
    return values.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def queue_records(values: DataFrame, schema) -> DataFrame:
    """Records of queued JSON texts, in the order of their sequence numbers."""
    return values.select("seq", F.from_json("value", schema).alias("r")).select("seq", "r.*")
