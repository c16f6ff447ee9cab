"""Time patterns of logs with ``ts`` (timestamp) in line order: intervals, periodic events, bursts, clusters, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ordered import with_neighbours, with_running_sum
from tallylog.functions.search import chain, first_at_or_beyond, numbered
from tallylog.functions.tables import written
from tallylog.functions.text import fixed

#: Event labels looked for, and the learner's thresholds in seconds.
LABELS = ("TIME_TICK", "REPORT")
GAP_SECONDS, BURST_SECONDS, CLUSTER_SECONDS, STEADY_SECONDS = 60.0, 1.0, 2.0, 5.0


def learner_time(timestamp: Column, strict: bool = False) -> Column:
    """The time in the first 17 characters of a learner timestamp, or null.

    ``strict`` gives null for every one, which is what the learner's own slice of the text gives.
    """
    if strict:
        return F.lit(None).cast("timestamp")
    return F.try_to_timestamp(F.substring(timestamp, 1, 17), F.lit("yyyyMMdd-HH:mm:ss"))


def timed(logs: DataFrame, strict: bool = False) -> DataFrame:
    """Logs with a time, as ``ts``; others go."""
    return logs.withColumn("ts", learner_time(F.col("timestamp"), strict)).where("ts is not null")


def _seconds_since(before: str, now: str) -> Column:
    return (F.unix_micros(now) - F.unix_micros(before)) / 1e6


def _with_interval(logs: DataFrame, group: list[str]) -> DataFrame:
    rows = with_neighbours(logs, group, "line_no", {"__before": (F.col("ts"), -1)})
    return rows.withColumn("interval", _seconds_since("__before", "ts")).drop("__before")


def interval_stats(logs: DataFrame, gap: float = GAP_SECONDS) -> DataFrame:
    """server, mean_interval, max_interval, min_interval, gaps (over ``gap`` seconds) of servers with two rows or more."""
    rows = _with_interval(logs.select("server", "line_no", "ts"), ["server"]).where("interval is not null")
    return rows.groupBy("server").agg(
        F.avg("interval").alias("mean_interval"), F.max("interval").alias("max_interval"), F.min("interval").alias("min_interval"),
        F.count_if(F.col("interval") > gap).alias("gaps"),
    )


def periodic_events(logs: DataFrame, labels: tuple[str, ...] = LABELS, over: int = 5) -> DataFrame:
    """server, label, interval, n, consistency, pattern of labels found in more than ``over`` messages; a message may have several."""
    found = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.contains(F.col("message"), x))
    rows = logs.select("server", "line_no", "ts", F.explode(found).alias("label"))
    rows = _with_interval(rows, ["server", "label"])
    out = rows.groupBy("server", "label").agg(
        F.count("*").alias("n"), F.avg("interval").alias("interval"), F.max("interval").alias("most"), F.min("interval").alias("least")
    )
    steady = F.when(F.col("most") - F.col("least") < STEADY_SECONDS, "high").otherwise("medium")
    pattern = F.concat(F.lit("every "), fixed(F.col("interval"), 1), F.lit(" seconds"))
    return out.where(F.col("n") > over).select("server", "label", "interval", "n", steady.alias("consistency"), pattern.alias("pattern"))


def bursts(logs: DataFrame, within: float = BURST_SECONDS, min_rows: int = 7, k: int | None = 5) -> DataFrame:
    """server, start_line, start, duration, n: maximal runs of rows with intervals below ``within`` seconds, ``min_rows`` long or longer."""
    rows = _with_interval(logs.select("server", "line_no", "ts"), ["server"])
    opens = F.when(F.coalesce(F.col("interval") < within, F.lit(False)), 0).otherwise(1)
    rows = with_running_sum(rows, ["server"], "line_no", opens, "island")
    out = rows.groupBy("server", "island").agg(
        F.min("line_no").alias("start_line"), F.min_by("ts", "line_no").alias("start"), F.max_by("ts", "line_no").alias("end"), F.count("*").alias("n")
    )
    out = out.where(F.col("n") >= min_rows).select("server", "start_line", "start", _seconds_since("start", "end").alias("duration"), "n")
    return _head(out, "start_line", k)


def _head(df: DataFrame, order: str, k: int | None) -> DataFrame:
    if k is None:
        return df
    rank = F.row_number().over(Window.partitionBy("server").orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def clusters(logs: DataFrame, within: float = CLUSTER_SECONDS, over: int = 3, k: int | None = 10, disjoint: bool = False) -> DataFrame:
    """server, line_no, ts, size, samples: for each row, the run of rows that begin less than ``within`` seconds after it.

    A run ends at the first row at or beyond that time.  Runs overlap, as each row anchors one; ``disjoint`` starts the next anchor
    after a reported run.  Those of more than ``over`` rows are kept, the first ``k`` of a server, with the first five messages.

    Time is cut into slices of ``within``; every row is copied into the slice before its own, so each anchor finds its run in
    its slice.  That is exact while times do not fall in line order; servers with falling times, and disjoint runs, go through a search for the first later row
    at or beyond each anchor's end (``functions/search.py``), which is spread over each server's lines.
    """
    rows = logs.select("server", "line_no", "ts", F.substring("message", 1, 30).alias("message"))
    if disjoint:
        return _head(_searched_clusters(rows, within, over, k, True), "line_no", k)
    falls = with_neighbours(rows, ["server"], "line_no", {"before": (F.col("ts"), -1)}).where("ts < before")
    falling = written(falls.select(F.col("server").alias("s")).distinct(), "falling")
    same = F.col("server").eqNullSafe(F.col("s"))
    out = _sliced_clusters(rows.join(falling, same, "left_anti"), within, over)
    if falling.limit(1).count():
        out = out.unionByName(_searched_clusters(rows.join(falling, same, "left_semi"), within, over, k, False))
    return _head(out, "line_no", k)


def _searched_clusters(rows: DataFrame, within: float, over: int, k: int | None, disjoint: bool) -> DataFrame:
    width = int(round(within * 1e6))
    placed = written(numbered(rows, ["server"], "line_no").withColumn("value", F.unix_micros("ts")), "placed")
    # one more row a server, later than all, ends the runs that no other row ends
    ends = placed.groupBy("server").agg((F.max("pos") + 1).alias("pos")).select("server", "pos", F.lit((1 << 63) - 1).alias("value"), F.lit(None).cast("long").alias("bound"))
    found = first_at_or_beyond(placed.select("server", "pos", "value", (F.col("value") + width).alias("bound")).unionByName(ends), ["server"])
    sizes = found.select("server", "pos", (F.col("end") - F.col("pos")).alias("size"))
    anchors = sizes.where(F.col("size") > over)
    if disjoint:
        sizes = written(sizes, "sizes")
        jumps = sizes.select("server", "pos", (F.col("pos") + F.when(F.col("size") > over, F.col("size")).otherwise(1)).alias("next"))
        visited = chain(jumps, ["server"]).select(F.col("server").alias("v"), F.col("pos").alias("at"))
        anchors = sizes.where(F.col("size") > over).join(visited, F.col("server").eqNullSafe(F.col("v")) & (F.col("pos") == F.col("at"))).select("server", "pos", "size")
    anchors = _head(anchors, "pos", k)
    wanted = anchors.select(F.col("server").alias("s"), F.col("pos").alias("anchor"), "size", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.least(F.lit(5), "size") - 1)).alias("at"))
    joined = placed.join(wanted, F.col("server").eqNullSafe(F.col("s")) & (F.col("pos") == F.col("at")))
    return joined.groupBy("server", "anchor", "size").agg(
        F.min_by("line_no", "pos").alias("line_no"), F.min_by("ts", "pos").alias("ts"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda m: m["message"]).alias("samples")
    ).select("server", "line_no", "ts", "size", "samples")


def _sliced_clusters(rows: DataFrame, within: float, over: int) -> DataFrame:
    width = int(round(within * 1e6))
    rows = rows.withColumn("us", F.unix_micros("ts")).withColumn("slice", F.expr(f"floor(us / {width})"))
    near = rows.select("*", F.explode(F.array("slice", F.col("slice") - 1)).alias("home"))
    by_slice = Window.partitionBy("server", "home").orderBy("line_no")
    near = near.withColumn("pos", F.row_number().over(by_slice))
    reach = Window.partitionBy("server", "home").orderBy("us").rangeBetween(Window.currentRow, width - 1)
    near = near.withColumn("size", F.max("pos").over(reach) - F.col("pos") + 1)
    near = near.withColumn("samples", F.collect_list("message").over(by_slice.rowsBetween(0, 4)))
    kept = near.where((F.col("home") == F.col("slice")) & (F.col("size") > over))
    return kept.select("server", "line_no", "ts", "size", F.slice("samples", F.lit(1), F.least(F.lit(5), F.col("size")).cast("int")).alias("samples"))


def hourly_profile(logs: DataFrame) -> DataFrame:
    """server, hour, n, share of the server's rows."""
    counts = logs.groupBy("server", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.min("line_no").alias("first_seen"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("server")))


def peak_hours(logs: DataFrame, k: int = 3) -> DataFrame:
    """server, hour, n: the ``k`` hours with the most rows, earlier seen first on ties."""
    order = Window.partitionBy("server").orderBy(F.desc("n"), "first_seen")
    return hourly_profile(logs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("server", "hour", "n", "rank")
