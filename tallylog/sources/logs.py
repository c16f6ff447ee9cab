"""Batch readers of log files, configurations and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raw lines the learner reads of a file.
MAX_LINES = 10_000

SERVER_CONFIG = T.StructType().add("servers", T.ArrayType(T.StructType().add("server_id", "string").add("log_file", "string")))
LEARNER_CONFIG = (
    T.StructType()
    .add("server", "string")
    .add("log_format", T.StructType().add("delimiter", "string").add("parts", T.ArrayType(T.StringType())).add("timestamp_format", "string"))
    .add("state_variables", T.MapType(T.StringType(), T.StructType().add("pattern", "string").add("type", "string")))
    .add("causal_chains", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
)
SERVERS = T.StructType().add("sid", "string").add("type", "string").add("instance", "integer").add("status", "string")
REQUEST = (
    T.StructType()
    .add("timestamp", "timestamp")
    .add("level", "string")
    .add("service", "string")
    .add("message", "string")
    .add("user_id", "string")
    .add("ip_address", "string")
    .add("action", "string")
    .add("metadata", T.MapType(T.StringType(), T.StringType()))
)


def read_lines(spark: SparkSession, path: str, max_lines: int | None = None, names: str = "*.log") -> DataFrame:
    """log_file, line_no, line of the files of a folder whose names match, numbered from 0 in file order.

    Lines are numbered by (block start, place in block): a running count over the blocks of a file plus the place within one,
    so a large file is numbered in parallel.  ``max_lines`` keeps raw lines, blank ones included.
    """
    rows = spark.read.option("pathGlobFilter", names).text(path)
    rows = rows.select(
        F.col("_metadata.file_path").alias("log_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    sizes = rows.groupBy("log_file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("log_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("log_file", "block").orderBy("place")) - 1
    out = rows.withColumn("within", within).join(sizes, ["log_file", "block"])
    out = out.select("log_file", (F.col("before") + F.col("within")).alias("line_no"), "line")
    return out if max_lines is None else out.where(F.col("line_no") < max_lines)


def first_log_file(spark: SparkSession, path: str, server: str | None = None) -> str | None:
    """The ``*.log`` file of a folder with the smallest path, of those whose names begin with ``server`` where it is given, or None."""
    files = spark.read.option("pathGlobFilter", f"{server or ''}*.log").format("binaryFile").load(path).select("path")
    return files.agg(F.min("path")).first()[0]


def read_server_config(spark: SparkSession, path: str) -> DataFrame:
    """server_id, log_file, position of a server configuration."""
    rows = spark.read.schema(SERVER_CONFIG).option("multiLine", True).json(path)
    return rows.select(F.posexplode("servers").alias("position", "s")).select("s.server_id", "s.log_file", "position")


def read_learner_config(spark: SparkSession, path: str) -> DataFrame:
    """A learner configuration as one nested row."""
    return spark.read.schema(LEARNER_CONFIG).option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registered servers; a missing, empty or broken file is an empty registry."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SERVERS)
    return spark.read.schema(SERVERS).option("mode", "DROPMALFORMED").json(path).where("sid is not null")


def read_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Ingestion requests dropped as JSON files, in batch or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(REQUEST).json(path)
