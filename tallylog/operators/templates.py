"""Template, component and overall statistics of parsed logs (server, line_no, timestamp, component, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.operators.parsing import template


def template_counts(logs: DataFrame, k: int | None = 50) -> DataFrame:
    """server, template, n, first_seen, total_templates: the ``k`` most frequent per server, earlier ones first on ties."""
    counts = logs.select("server", "line_no", template(F.col("message")).alias("template"))
    counts = counts.groupBy("server", "template").agg(F.count("*").alias("n"), F.min("line_no").alias("first_seen"))
    total = counts.groupBy(F.col("server").alias("s")).agg(F.count("*").alias("total_templates"))
    if k is not None:
        order = Window.partitionBy("server").orderBy(F.desc("n"), "first_seen", "template")
        counts = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    return counts.join(total, F.col("server").eqNullSafe(F.col("s"))).drop("s")


def component_counts(logs: DataFrame) -> DataFrame:
    """server, component, n, first_seen."""
    return logs.groupBy("server", "component").agg(F.count("*").alias("n"), F.min("line_no").alias("first_seen"))


def log_statistics(logs: DataFrame) -> DataFrame:
    """A row per server: total_logs, unique components and templates, first and last timestamp, and the rate's constant text.

    The timestamps are those of the first and last lines that have one, where at least two do.
    """
    stamped = F.col("timestamp") != ""
    out = logs.withColumn("template", template(F.col("message"))).groupBy("server").agg(
        F.count("*").alias("total_logs"),
        F.count_distinct("component").alias("unique_components"),
        F.count_distinct("template").alias("unique_templates"),
        F.count_if(stamped).alias("stamped"),
        F.min_by(F.when(stamped, F.col("timestamp")), F.when(stamped, F.col("line_no"))).alias("first_timestamp"),
        F.max_by(F.when(stamped, F.col("timestamp")), F.when(stamped, F.col("line_no"))).alias("last_timestamp"),
    )
    enough = F.col("stamped") >= 2
    return out.select(
        "server", "total_logs", "unique_components", "unique_templates",
        F.when(enough, F.col("first_timestamp")).alias("first_timestamp"),
        F.when(enough, F.col("last_timestamp")).alias("last_timestamp"),
        F.when(enough, "N/A").alias("average_rate"),
    )
