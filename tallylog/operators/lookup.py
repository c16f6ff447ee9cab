"""Which server a log file belongs to, its SID, and its type's script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most keys of a server configuration: four for each server.
MOST_KEYS = 100_000


def file_name(path: Column) -> Column:
    """The part after the last slash."""
    return F.regexp_extract(path, "[^/]*$", 0)


def base_name(path: Column) -> Column:
    """File name without ``_<number>.log``, then without ``.log``."""
    return F.regexp_replace(F.regexp_replace(file_name(path), r"_\d+\.log$", ""), r"\.log$", "")


def lookup_keys(config: DataFrame) -> DataFrame:
    """key, server_id, key_order from (server_id, log_file, position): four keys per server, in order.

    Of equal keys the last server wins, at the place where the key first stood.
    """
    name = file_name(F.col("log_file"))
    keys = F.array("log_file", name, F.replace(name, F.lit(".log"), F.lit("")), F.lower(F.replace(F.col("server_id"), F.lit("_SERVER"), F.lit(""))))
    rows = config.select("server_id", "position", F.posexplode(keys).alias("i", "key"))
    place = F.col("position") * 4 + F.col("i")
    return rows.groupBy("key").agg(F.max_by("server_id", place).alias("server_id"), F.min(place).alias("key_order"))


def match_servers(files: DataFrame, keys: DataFrame, column: str = "log_file") -> DataFrame:
    """Add server_id to each distinct file: by path, file name, base name, then the first key within the base name; else UNKNOWN.

    The first three are equi-joins.  For the last, the keys of a configuration, of which there are at most MOST_KEYS, stand in one row in their order, and
    each file takes the first that its base name contains.
    """
    rows = files.select(column).distinct()
    rows = rows.withColumns({"k0": F.col(column), "k1": file_name(F.col(column)), "k2": base_name(F.col(column))})
    for i in range(3):
        exact = keys.select(F.col("key").alias(f"k{i}"), F.col("server_id").alias(f"s{i}"))
        rows = rows.join(exact, f"k{i}", "left")
    low = keys.groupBy(F.lower("key").alias("part")).agg(F.min_by("server_id", "key_order").alias("server_id"), F.min("key_order").alias("key_order"))
    packed = F.array_sort(F.collect_list(F.struct("key_order", "part", "server_id")))
    listed = low.agg(F.when(F.count("*") > MOST_KEYS, F.raise_error(F.lit(f"more than {MOST_KEYS} keys of servers"))).otherwise(packed).alias("low"))
    rows = rows.withColumn("low", listed.scalar())
    within = F.get(F.filter("low", lambda k: F.contains(F.lower(F.col("k2")), k["part"])), F.lit(0))["server_id"]
    return rows.select(column, F.coalesce("s0", "s1", "s2", within, F.lit("UNKNOWN")).alias("server_id"))


def file_sids(lines: DataFrame) -> DataFrame:
    """log_file, sid of files whose first line (line_no 0) is a ``# SID:`` header."""
    head = lines.where((F.col("line_no") == 0) & F.col("line").startswith("# SID:"))
    return head.groupBy("log_file").agg(F.min(F.trim(F.expr("substring(line, 7)"))).alias("sid"))


def with_sids(rows: DataFrame, sids: DataFrame) -> DataFrame:
    """Add the file's sid, null where it has none."""
    return rows.join(sids.select("log_file", "sid"), "log_file", "left")


def missing_sids(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """(server_type, instance) that the registry does not have."""
    return wanted.join(registry, ["server_type", "instance"], "left_anti")


def script_paths(servers: DataFrame, scripts: dict[str, str]) -> DataFrame:
    """Add the script of each server's type, null where there is none."""
    path = F.lit(None).cast("string")
    for kind, script in scripts.items():
        path = F.when(F.col("type") == kind, script).otherwise(path)
    return servers.withColumn("script", path)


def ranked(df: DataFrame, group: str, order: Column) -> DataFrame:
    """Add ``place`` from 1 within a group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
