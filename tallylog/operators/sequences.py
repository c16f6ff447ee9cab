"""Event order within a server: states, transitions, chains, probabilities and n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ordered import with_neighbours

#: Characters of a state and of an event, and the flags looked for.
STATE_CHARS, EVENT_CHARS = 30, 50
#: Line numbers stay below this, so (component, line) fits one number.
PLACE_STEP = 1 << 40
FLAGS = ("SCREEN_ON", "SCREEN_OFF", "true", "false")


def flag_counts(logs: DataFrame, flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """server, flag, n: messages that contain each flag; flags without any are left out."""
    found = F.filter(F.array(*[F.lit(f) for f in flags]), lambda f: F.contains(F.col("message"), f))
    return logs.select("server", F.explode(found).alias("flag")).groupBy("server", "flag").agg(F.count("*").alias("n"))


def _state_changes(logs: DataFrame) -> DataFrame:
    state = F.substring("message", 1, STATE_CHARS)
    rows = logs.select("server", "line_no", state.alias("to_state"))
    rows = with_neighbours(rows, ["server"], "line_no", {"from_state": (F.col("to_state"), -1)})
    return rows.where((F.col("from_state") != "") & (F.col("from_state") != F.col("to_state")))


def state_transitions(logs: DataFrame, k: int | None = 20) -> DataFrame:
    """server, from_state, to_state, n, total_sequences: the ``k`` most frequent changes of state, earlier ones first on ties."""
    counts = _state_changes(logs).groupBy("server", "from_state", "to_state").agg(F.count("*").alias("n"), F.min("line_no").alias("first_seen"))
    total = counts.groupBy(F.col("server").alias("s")).agg(F.sum("n").alias("total_sequences"))
    if k is not None:
        order = Window.partitionBy("server").orderBy(F.desc("n"), "first_seen")
        counts = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return counts.join(total, F.col("server").eqNullSafe(F.col("s"))).select("server", "from_state", "to_state", "n", "first_seen", "total_sequences")


def next_events(logs: DataFrame) -> DataFrame:
    """server, component, component_rank, line_no, from_event, to_event, time_diff: each event with the next of its component.

    Components rank by first appearance, so (component_rank, line_no) is the order of the chains.  time_diff is the
    constant 1; time_diff_sec is the real one where the logs have ``ts``.
    """
    event = F.substring("message", 1, EVENT_CHARS)
    columns = ["server", "component", "line_no", *(["ts"] if "ts" in logs.columns else [])]
    rows = logs.select(*columns, event.alias("from_event"))
    values = {"to_event": (F.col("from_event"), 1)}
    if "ts" in logs.columns:
        values["next_ts"] = (F.col("ts"), 1)
    rows = with_neighbours(rows, ["server", "component"], "line_no", values).where(F.col("to_event").isNotNull())
    first = logs.groupBy("server", "component").agg(F.min("line_no").alias("component_rank"))
    first = first.select(F.col("server").alias("s"), F.col("component").alias("c"), "component_rank")
    rows = rows.join(first, F.col("server").eqNullSafe(F.col("s")) & F.col("component").eqNullSafe(F.col("c"))).drop("s", "c")
    rows = rows.withColumn("time_diff", F.lit(1))
    if "ts" in logs.columns:
        rows = rows.withColumn("time_diff_sec", (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1e6).drop("next_ts", "ts")
    return rows


def chains(logs: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` chains of each server and their total number."""
    rows = next_events(logs)
    total = rows.groupBy(F.col("server").alias("s")).agg(F.count("*").alias("total_chains"))
    order = Window.partitionBy("server").orderBy("component_rank", "line_no")
    head = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return head.join(total, F.col("server").eqNullSafe(F.col("s"))).drop("s")


def transition_probabilities(logs: DataFrame, k: int | None = 20) -> DataFrame:
    """server, from_event, to_event, n, probability of the first ``k`` source events by first appearance."""
    counts = next_events(logs).groupBy("server", "from_event", "to_event").agg(
        F.count("*").alias("n"), F.min(F.struct("component_rank", "line_no")).alias("seen")
    )
    sources = counts.groupBy(F.col("server").alias("s"), F.col("from_event").alias("f")).agg(F.sum("n").alias("total"), F.min("seen").alias("first"))
    if k is not None:
        order = Window.partitionBy("s").orderBy("first")
        sources = sources.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    joined = counts.join(sources, F.col("server").eqNullSafe(F.col("s")) & F.col("from_event").eqNullSafe(F.col("f")))
    return joined.select("server", "from_event", "to_event", "n", (F.col("n") / F.col("total")).alias("probability"))


def trigrams(logs: DataFrame, k: int | None = 10, within_component: bool = False) -> DataFrame:
    """server, first_event, second_event, third_event, n: the ``k`` most frequent runs of three source events.

    The sequence is that of the chains and runs on across components unless ``within_component``.
    """
    rows = next_events(logs)
    ranks = rows.select("server", "component_rank").distinct()
    order = Window.partitionBy("server").orderBy("component_rank")
    ranks = ranks.select(F.col("server").alias("s"), F.col("component_rank").alias("r"), F.row_number().over(order).alias("dense"))
    rows = rows.join(ranks, F.col("server").eqNullSafe(F.col("s")) & (F.col("component_rank") == F.col("r")))
    group = ["server", "component_rank"]
    # a component's second and third events may stand in the next components; lines keep each component's own order
    place = F.col("dense").cast("long") * PLACE_STEP + F.col("line_no")
    rows = rows.select("server", "component_rank", place.alias("place"), F.col("from_event").alias("first_event"))
    values = {"second_event": (F.col("first_event"), 1), "third_event": (F.col("first_event"), 2)}
    rows = with_neighbours(rows, group if within_component else ["server"], "place", values)
    rows = rows.where(F.col("third_event").isNotNull())
    counts = rows.groupBy("server", "first_event", "second_event", "third_event").agg(F.count("*").alias("n"), F.min("place").alias("first_seen"))
    if k is not None:
        best = Window.partitionBy("server").orderBy(F.desc("n"), "first_seen")
        counts = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return counts.select("server", "first_event", "second_event", "third_event", "n", "first_seen")


def configured_chains(logs: DataFrame, chains: dict[str, list[str]]) -> DataFrame:
    """server, chain, step, place, n: messages that contain each step of the configured chains."""
    steps = F.array(*[F.struct(F.lit(name).alias("chain"), F.lit(i).alias("place"), F.lit(step).alias("step")) for name, listed in sorted(chains.items()) for i, step in enumerate(listed)])
    found = F.filter(steps, lambda x: F.contains(F.col("message"), x["step"]))
    return logs.select("server", F.inline(found)).groupBy("server", "chain", "place", "step").agg(F.count("*").alias("n"))
