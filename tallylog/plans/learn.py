"""The learner: all pattern sections of parsed logs, and their JSON document.

``python -m tallylog.plans.learn --server healthcare --logs DIR --out DIR`` reads the file of that server with the smallest path, the first
10,000 lines of it; ``--all-files`` and ``--max-lines 0`` read everything, and ``--config FILE`` adds the sections of a learner configuration.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.operators import sequences, templates, temporal, values
from tallylog.operators.parsing import parse_learner
from tallylog.session import session
from tallylog.sources.logs import MAX_LINES, first_log_file, read_learner_config, read_lines

#: Servers that the command knows.
SERVERS = ("healthcare", "db", "api", "auth", "infra", "hpc", "linux", "spark", "windows", "zookeeper")


def sections(logs: DataFrame) -> dict[str, DataFrame]:
    """Every section of the patterns, as a DataFrame with a server column."""
    numbers = values.extract_values(logs)
    timed = temporal.timed(logs)
    return {
        "templates": templates.template_counts(logs),
        "components": templates.component_counts(logs),
        "statistics": templates.log_statistics(logs),
        "counters": values.counters(logs),
        "flags": sequences.flag_counts(logs),
        "tracked_values": values.tracked_values(logs),
        "state_transitions": sequences.state_transitions(logs),
        "causal_chains": sequences.chains(logs),
        "transition_probabilities": sequences.transition_probabilities(logs),
        "event_sequences": sequences.trigrams(logs),
        "value_relations": values.value_relations(numbers),
        "increments": values.increments(numbers),
        "progressions": values.progressions(numbers),
        "distributions": values.distributions(numbers),
        "periodic_events": temporal.periodic_events(timed),
        "clusters": temporal.clusters(timed),
        "bursts": temporal.bursts(timed),
        "intervals": temporal.interval_stats(timed),
        "hourly": temporal.hourly_profile(timed),
        "peak_hours": temporal.peak_hours(timed),
    }


def parsed_lines(spark: SparkSession, path: str, max_lines: int | None = MAX_LINES) -> DataFrame:
    """Parsed lines of the log files of a folder, or of one file; the file name is the server."""
    lines = read_lines(spark, path, max_lines).withColumn("server", F.regexp_extract("log_file", "([^/]*)$", 1))
    return parse_learner(lines.select("server", "line_no", "line"))


def learn(spark: SparkSession, path: str, max_lines: int | None = MAX_LINES, config: str | None = None) -> dict[str, DataFrame]:
    """Sections of the log files of a folder, with those of a learner configuration where one is given."""
    logs = parsed_lines(spark, path, max_lines)
    found = sections(logs)
    if config:
        settings = read_learner_config(spark, config).first()
        if settings["state_variables"]:
            found["state_variables"] = values.state_values(logs, {k: v["pattern"] for k, v in settings["state_variables"].items()})
        if settings["causal_chains"]:
            found["configured_chains"] = sequences.configured_chains(logs, dict(settings["causal_chains"]))
    return found


def write_patterns(found: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section; sections differ in columns, and none has to fit the driver."""
    for name, rows in found.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--server", choices=SERVERS, required=True)
    parser.add_argument("--logs", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config")
    parser.add_argument("--all-files", action="store_true")
    parser.add_argument("--max-lines", type=int, default=MAX_LINES)
    args = parser.parse_args()
    spark = session()
    path = args.logs if args.all_files else first_log_file(spark, args.logs, args.server) or first_log_file(spark, args.logs)
    if path is None:
        parser.error(f"no log files in {args.logs}")
    write_patterns(learn(spark, path, args.max_lines or None, args.config), f"{args.out}/{args.server}")


if __name__ == "__main__":
    main()
