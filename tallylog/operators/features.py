"""Trailing-window features of arriving events (seq, ts, event_type, user)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ordered import with_running_sum
from tallylog.functions.search import first_at_or_beyond, numbered
from tallylog.functions.tables import written
from tallylog.operators.parsing import event_code

#: Fixed value: seconds of the trailing window.
WINDOW_SECONDS = 300
#: Seconds of time that one task counts together, for each key.
SLICE_SECONDS = 300


def trailing_count(rows: DataFrame, key: list[str], flag: Column, name: str, seconds: float, peers: bool = False) -> DataFrame:
    """Add how many flagged rows of the key lie in ``(ts - seconds, ts]`` and arrived no later.

    Of rows at the same time only earlier arrivals count, by ``seq``, which no two rows share; with ``peers`` all of them do, as in SQL's RANGE.  The count is a difference of running counts in the order of time: at the row,
    less where its window begins.  Rows and begins of windows are points of one order, which is cut into slices of SLICE_SECONDS
    whatever the window; a slice goes on from the sum of those before it, so a key with very many rows is spread over time.
    """
    width, slice_ = int(round(seconds * 1e6)), int(SLICE_SECONDS * 1e6)
    keyed = rows.select(*key, "seq", F.coalesce(flag, F.lit(False)).cast("long").alias("__flag"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"))
    points = keyed.select("*", F.explode(F.array(F.lit(0), F.lit(width).cast("long"))).alias("__back"))
    points = points.withColumns({"__at": F.col("__us") - F.col("__back"), "__sign": F.when(F.col("__back") == 0, 1).otherwise(-1)})
    points = points.withColumns({"__slice": F.expr(f"floor(__at / {slice_})"), "__counted": F.when(F.col("__back") == 0, F.col("__flag")).otherwise(0)})
    sums = points.groupBy(*key, "__slice").agg(F.sum("__counted").alias("__sum"))
    earlier = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("__slice").alias("__s"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    same = F.col("__slice") == F.col("__s")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    # at one time, rows come by arrival and then the windows that begin there
    order = Window.partitionBy(*key, "__slice").orderBy("__at", F.desc("__sign"), *([] if peers else ["seq"])).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = points.withColumn("__upto", F.sum("__counted").over(order)).join(offsets, same)
    counts = counted.groupBy(F.col("seq").alias("__seq")).agg(F.sum(F.col("__sign") * (F.col("__upto") + F.col("__offset"))).alias(name))
    return rows.join(counts, F.col("seq") == F.col("__seq")).select(*rows.columns, name)


def event_features(events: DataFrame, seconds: float = WINDOW_SECONDS, peers: bool = False) -> DataFrame:
    """Add login_count, error_count and event_type_code, for events that arrive in time order.

    login_count counts the user's logins and is 0 for other events; error_count counts all service errors and is given to every
    event.  ``peers`` also counts later arrivals at the same time.  The streaming processor has the exact result for events that arrive out of order.
    """
    login = F.col("event_type") == "login"
    rows = trailing_count(events, ["user"], login, "login_count", seconds, peers)
    rows = rows.withColumn("login_count", F.when(F.col("event_type") == "login", F.col("login_count")).otherwise(0).cast("long"))
    rows = trailing_count(rows, [], F.col("event_type") == "service_error", "error_count", seconds, peers)
    return rows.withColumn("error_count", F.col("error_count").cast("long")).withColumn("event_type_code", event_code(F.col("event_type")))


def arrival_count(rows: DataFrame, key: list[str], flag: Column, name: str, seconds: float) -> DataFrame:
    """Add how many flagged rows of the key are held when each row arrives, in any order of time.

    Rows arrive in the order of ``seq``, a whole number that no two rows share.  An arrival first removes, for good, what is not
    within ``seconds`` before its own time.  So a row is held from its arrival until the first later arrival whose time is ``seconds`` after its own or more, and the
    count is a running sum of arrivals less removals; both the search and the sum are spread over a key's rows.
    """
    width = int(round(seconds * 1e6))
    placed = written(numbered(rows.withColumns({"__flag": F.coalesce(flag, F.lit(False)), "__us": F.unix_micros(F.col("ts").cast("timestamp"))}), key, "seq", "__pos"), "arrivals")
    asked = placed.select(*key, F.col("__pos").alias("pos"), F.col("__us").alias("value"), F.when(F.col("__flag"), F.col("__us") + width).alias("bound"))
    gone = first_at_or_beyond(asked, key).where("end is not null").groupBy(*key, "end").agg(F.count("*").alias("__gone"))
    gone = gone.select(*[F.col(c).alias(f"__k_{c}") for c in key], F.col("end").alias("__end"), "__gone")
    same = F.col("__pos") == F.col("__end")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    change = F.col("__flag").cast("long") - F.coalesce("__gone", F.lit(0))
    return with_running_sum(placed.join(gone, same, "left"), key, "__pos", change, name).select(*rows.columns, name)


def arrival_features(events: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Add login_count, error_count and event_type_code, for events that arrive in any order: what the stream gives.

    A user's logins are removed by that user's later logins, errors by all later events.
    """
    logins = arrival_count(events.where("event_type = 'login'"), ["user"], F.lit(True), "login_count", seconds)
    errors = arrival_count(events, [], F.col("event_type") == "service_error", "error_count", seconds)
    joined = errors.join(logins.select(F.col("seq").alias("__seq"), "login_count"), F.col("seq") == F.col("__seq"), "left")
    counts = {"login_count": F.coalesce("login_count", F.lit(0)).cast("long"), "error_count": F.col("error_count").cast("long"), "event_type_code": event_code(F.col("event_type"))}
    return joined.withColumns(counts).select(*events.columns, *counts)
