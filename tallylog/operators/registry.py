"""Server registry: instance numbers, SIDs, groups by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def max_instances(servers: DataFrame, types: DataFrame) -> DataFrame:
    """type, last: the largest instance of each type of ``types``, 0 where it has none."""
    known = servers.groupBy("type").agg(F.max("instance").alias("last"))
    return types.select("type").distinct().join(known, "type", "left").na.fill(0, ["last"])


def assign_instances(new: DataFrame, servers: DataFrame, order: str) -> DataFrame:
    """Give new servers the next instances of their type, in ``order``."""
    last = max_instances(servers, new)
    number = F.row_number().over(Window.partitionBy("type").orderBy(order))
    return new.withColumn("number", number).join(last, "type").withColumn("instance", F.col("last") + F.col("number")).drop("number", "last")


def servers_by_type(servers: DataFrame) -> DataFrame:
    """type, n, first and last sid, of registered servers; ``listed_by_type`` has the servers themselves."""
    return servers.groupBy("type").agg(F.count("*").alias("n"), F.min_by("sid", "instance").alias("first_sid"), F.max_by("sid", "instance").alias("last_sid"))


#: Servers of a list.
PAGE = 10_000


def listed_by_type(servers: DataFrame, page: int = PAGE) -> DataFrame:
    """type, page, servers: the servers (instance, sid) of each type in the order of their instances, ``page`` instances in a list."""
    rows = servers.select("type", F.expr(f"instance div {page}").alias("page"), F.struct("instance", "sid").alias("server"))
    return rows.groupBy("type", "page").agg(F.array_sort(F.collect_list("server")).alias("servers"))


def digest_text(seed: Column, chars: int) -> Column:
    """Letters and digits of the first ``chars`` characters of the base64 of a SHA-256."""
    return F.regexp_replace(F.substring(F.base64(F.unhex(F.sha2(seed, 256))), 1, chars), "[^A-Za-z0-9]", "")


def make_sid(seed: Column, server_type: Column, instance: Column, chars: int = 30, digits: int = 0) -> Column:
    """``<digest>_<TYPE>_<instance>``; ``chars=20, digits=3`` is the launcher's form."""
    number = F.lpad(instance.cast("string"), digits, "0") if digits else instance.cast("string")
    return F.concat_ws("_", digest_text(seed, chars), F.upper(server_type), number)


def register(new: DataFrame, registry: DataFrame, order: str = "request") -> DataFrame:
    """The registry with a row for each new server: type, instance, sid, status; seeds come from ``request``."""
    rows = assign_instances(new, registry, order)
    rows = rows.withColumn("sid", make_sid(F.col(order).cast("string"), F.col("type"), F.col("instance"))).withColumn("status", F.lit("registered"))
    return registry.select("type", "instance", "sid", "status").unionByName(rows.select("type", "instance", "sid", "status"))
