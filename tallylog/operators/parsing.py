"""Raw lines to structured rows: learner and collector parsing, templates, event messages, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.text import captured, first_matching, strip

#: The timestamp prefixes of the log formats.
COMPACT_TIME = r"^\d{8}-\d{2}:\d{2}:\d{2}"
SYSLOG_TIME = r"(?U)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d+\s+\d{2}:\d{2}:\d{2}"
ISO_TIME = r"(?U)^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
ISO_WITH_FRACTION = r"(?U)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,.]\d+)"
#: The event messages.
LOGIN = r"(?U)User (\w+) logged in from ([\d\.]+)"
SERVICE_ERROR = r"(?Ud)Service (\w+) failed with error (.+)"
#: The levels a request may have.
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")


def drop_blank(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines stripped of white space, without empty ones."""
    return lines.withColumn(column, strip(F.col(column))).where(F.col(column) != "")


def learner_fields(line: Column, parts: Column | None = None) -> dict[str, Column]:
    """timestamp, component, user_id, message and raw of a stripped line; ``parts`` are its parts between bars where they were made before.

    A line of four or more parts between bars has them in that order, the message with the bars it holds;
    any other is a message of the unknown component.
    """
    parts = F.split(line, r"\|", -1) if parts is None else parts
    full = F.size(parts) >= 4

    def part(i: int, otherwise: str) -> Column:
        return F.when(full, strip(parts[i])).otherwise(F.lit(otherwise))

    message = strip(F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(1))), "|"))
    return {
        "timestamp": part(0, ""),
        "component": part(1, "unknown"),
        "user_id": part(2, ""),
        "message": F.when(full, message).otherwise(line),
        "raw": line,
    }


def parse_learner(lines: DataFrame, column: str = "line", drop_header: bool = False) -> DataFrame:
    """Add the learner's fields; blank lines go, and ``# SID:`` headers where asked."""
    rows = drop_blank(lines, column)
    if drop_header:
        rows = rows.where(~F.col(column).startswith("# SID:"))
    # a column of their own, so that a line is split once
    split = rows.withColumn("__parts", F.split(column, r"\|", -1))
    return split.select(*[c for c in rows.columns if c != column], *[v.alias(k) for k, v in learner_fields(F.col(column), F.col("__parts")).items()])


def collector_timestamp(line: Column) -> Column:
    """The timestamp the collector finds, or "unknown".

    With bars: the first part in compact form.  Else: syslog (three tokens), or ISO with its fraction.
    """
    parts = F.transform(F.split(line, r"\|", -1), strip)
    tokens = F.split(strip(line), r"(?U)\s+", -1)
    iso = F.coalesce(captured(line, ISO_WITH_FRACTION), F.substring(line, 1, 19))
    return (
        F.when(F.contains(line, F.lit("|")), F.coalesce(first_matching(parts, COMPACT_TIME), F.lit("unknown")))
        .when(line.rlike(SYSLOG_TIME), F.array_join(F.slice(tokens, 1, 3), " "))
        .when(line.rlike(ISO_TIME), iso)
        .otherwise(F.lit("unknown"))
    )


def event_time(line: Column) -> Column:
    """The timestamp of a line in any of the formats, as a timestamp; null where there is none (syslog has no year)."""
    first = strip(F.split(line, r"\|", -1)[0])
    return F.coalesce(
        F.try_to_timestamp(F.substring(first, 1, 17), F.lit("yyyyMMdd-HH:mm:ss")),
        F.try_to_timestamp(F.regexp_replace(F.substring(first, 1, 19), r"\s+", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def collect_entries(lines: DataFrame, column: str = "line") -> DataFrame:
    """timestamp, server_type, sid, message, log_file of every line that is neither blank nor a header.

    ``lines`` has server_type, sid and log_file beside the line.
    """
    rows = drop_blank(lines, column).where(~F.col(column).startswith("# SID:"))
    return rows.select(
        collector_timestamp(F.col(column)).alias("timestamp"), "server_type", "sid", F.col(column).alias("message"), "log_file"
    )


def template(message: Column) -> Column:
    """A message with its numbers, then hexadecimal words, then UUIDs replaced by ``<*>``."""
    out = F.regexp_replace(message, r"(?U)\b\d+\b", "<*>")
    out = F.regexp_replace(out, "0x[0-9a-f]+", "<*>")
    return F.regexp_replace(out, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<*>")


def parsed_event(message: Column) -> Column:
    """struct(event_type, user, ip, service, error): a login, else a service error, else unknown."""
    login, failed = message.rlike(LOGIN), message.rlike(SERVICE_ERROR)
    only_failed = ~login & failed
    return F.struct(
        F.when(login, "login").when(failed, "service_error").otherwise("unknown").alias("event_type"),
        F.when(login, F.regexp_extract(message, LOGIN, 1)).alias("user"),
        F.when(login, F.regexp_extract(message, LOGIN, 2)).alias("ip"),
        F.when(only_failed, F.regexp_extract(message, SERVICE_ERROR, 1)).alias("service"),
        F.when(only_failed, F.regexp_extract(message, SERVICE_ERROR, 2)).alias("error"),
    )


def event_code(event_type: Column) -> Column:
    """1 for a login, 2 for a service error, 0 for anything else."""
    return F.when(event_type == "login", 1).when(event_type == "service_error", 2).otherwise(0)


def merged_metadata(metadata: Column, parsed: Column, features: Column) -> Column:
    """Client metadata with the keys parsed and features set over it, as JSON texts."""
    own = F.create_map(F.lit("parsed"), F.to_json(parsed), F.lit("features"), F.to_json(features))
    kept = F.map_filter(F.coalesce(metadata, F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin("parsed", "features"))
    return F.map_concat(kept, own)


def rejection(level: Column, service: Column, message: Column, timestamp: Column) -> Column:
    """Why a request is not valid, or null."""
    return (
        F.when(timestamp.isNull(), "timestamp")
        .when(level.isNull() | ~level.isin(*LEVELS), "level")
        .when(service.isNull() | (F.length(service) < 2), "service")
        .when(message.isNull() | (F.length(message) < 1), "message")
    )


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests with their ``reason``)."""
    marked = requests.withColumn("reason", rejection(F.col("level"), F.col("service"), F.col("message"), F.col("timestamp")))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def format_line(server_type: Column, ts: Column, component: Column, user_id: Column, process: Column, message: Column) -> Column:
    """A log line in the layout of its server type."""
    who = F.when(F.coalesce(process, F.lit("")) != "", F.concat_ws(" ", ts, component, process)).otherwise(F.concat_ws(" ", ts, component))
    return (
        F.when(server_type == "healthcare", F.concat_ws("|", ts, component, user_id, message))
        .when(server_type == "linux", F.concat(who, F.lit(": "), message))
        .otherwise(F.concat_ws("|", ts, component, message))
    )
