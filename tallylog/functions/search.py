"""Searches forward in long ordered groups: the first later row at or beyond a bound, and the rows that a chain of jumps visits.

A group's order is cut into blocks of rows, each packed into one row of arrays, and a tree of maxima is built over the blocks.  A task that has a
block answers what the block itself can answer, and finds in the maxima beside its ancestors where the rest must go; those questions are
sent there in packs and descend to a block, by equi-joins alone.  A group's size matters to no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.functions.ordered import with_running_sum
from tallylog.functions.tables import written

#: Rows of a block, and children of a node of the tree of maxima.
ROWS, FAN = 16_384, 1_024


def numbered(rows: DataFrame, group: list[str], order: str, name: str = "pos") -> DataFrame:
    """Add each row's place in its group, from 0, by a whole number that is distinct within the group."""
    return with_running_sum(rows, group, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def _on(group: list[str], prefix: str, *more: Column) -> Column:
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(prefix + c))
    for c in more:
        on = on & c
    return on


def _renamed(df: DataFrame, group: list[str], prefix: str, **columns: Column) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in group], *[c.alias(name) for name, c in columns.items()])


def _packed(rows: DataFrame, group: list[str], values: list[str], size: int) -> DataFrame:
    """``block`` and an array of each of ``values`` in the order of ``pos``."""
    packed = F.array_sort(F.collect_list(F.struct("pos", *values)))
    rows = rows.groupBy(*group, F.expr(f"pos div {size}").alias("block")).agg(packed.alias("__rows"))
    return rows.select(*group, "block", *[F.transform("__rows", lambda r: r[v]).alias(v) for v in values])  # noqa: B023  called at once


def _numbers(array: pa.Array, i: int, none: int = 0) -> np.ndarray:
    return array[i].values.fill_null(none).to_numpy(zero_copy_only=False)


def next_in_block(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each place the first later one whose value is at or beyond the bound, or the number of places."""
    n = len(values)
    most = [values]
    while 2 << (len(most) - 1) <= n:
        half = 1 << (len(most) - 1)
        most.append(np.maximum(most[-1][:-half], most[-1][half:]))
    at = np.arange(1, n + 1)
    for k in range(len(most) - 1, -1, -1):
        inside = at <= n - (1 << k)
        skip = np.zeros(n, bool)
        skip[inside] = most[k][at[inside]] < bounds[inside]
        at[skip] += 1 << k
    return at


class _Out:
    """Packs of answers (level -1: places and ends) and of questions (level, node: places and bounds)."""

    def __init__(self, group: list[str]):
        self.group, self.rows = group, {name: [] for name in (*group, "level", "node", "places", "found")}

    def add(self, key: tuple, level: int, node: int, places: np.ndarray, found: np.ndarray) -> None:
        if len(places):
            for name, value in zip(self.rows, (*key, level, node, places, found)):
                self.rows[name].append(value)

    def asked(self, key: tuple, level: int, nodes: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> None:
        order = np.argsort(nodes, kind="stable")
        cuts = np.flatnonzero(np.diff(nodes[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                self.add(key, level, int(nodes[part[0]]), places[part], bounds[part])

    def batch(self, types: list[pa.DataType]) -> pa.RecordBatch:
        kinds = [*types, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(self.rows.values(), kinds)], names=list(self.rows))


def _keys(batch: pa.RecordBatch, group: list[str]) -> tuple[list[tuple], list[pa.DataType]]:
    columns = [batch.column(i).to_pylist() for i in range(len(group))]
    return (list(zip(*columns)) if group else [()] * len(batch)), [batch.column(i).type for i in range(len(group))]


def _search_blocks(group: list[str], levels: int, size: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = len(group)
        for batch in batches:
            keys, types = _keys(batch, group)
            out = _Out(group)
            for i, key in enumerate(keys):
                block = batch.column(g)[i].as_py()
                values, bounds = _numbers(batch.column(g + 1), i), _numbers(batch.column(g + 2), i)
                asks = batch.column(g + 2)[i].values.is_valid().to_numpy(zero_copy_only=False)
                ends = next_in_block(values, bounds)
                here = asks & (ends < len(values))
                out.add(key, -1, 0, np.flatnonzero(here) + block * size, ends[here] + block * size)
                left = np.flatnonzero(asks & (ends >= len(values)))
                for level in range(levels):
                    own = block // fan**level
                    beyond = np.maximum.accumulate(_numbers(batch.column(g + 3 + level), i)[own % fan + 1 :])
                    at = np.searchsorted(beyond, bounds[left])
                    hit = at < len(beyond)
                    out.asked(key, level, own + 1 + at[hit], left[hit] + block * size, bounds[left[hit]])
                    left = left[~hit]
                out.add(key, -1, 0, left + block * size, np.full(len(left), -1))
            yield out.batch(types)

    return run


def _descend(group: list[str], level: int, width: int):
    """Questions of one node each, beside the node's ``values``, to its children; from level 0 to answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = len(group)
        for batch in batches:
            keys, types = _keys(batch, group)
            out = _Out(group)
            for i, key in enumerate(keys):
                node = batch.column(g)[i].as_py()
                places, bounds = _numbers(batch.column(g + 1), i), _numbers(batch.column(g + 2), i)
                at = np.searchsorted(np.maximum.accumulate(_numbers(batch.column(g + 3), i)), bounds) + node * width
                if level:
                    out.asked(key, level - 1, at, places, bounds)
                else:
                    out.add(key, -1, 0, places, at)
            yield out.batch(types)

    return run


def first_at_or_beyond(rows: DataFrame, group: list[str], size: int = ROWS, fan: int = FAN) -> DataFrame:
    """``group, pos, end``: for each row with a bound, the place of the first later row of its group whose ``value`` is the bound or more, or null.

    ``rows`` has the group's columns, ``pos`` (from 0 without gaps, as of ``numbered``), ``value`` (long, null never reaches a bound) and ``bound`` (long, or null for
    rows that ask nothing).
    """
    # the least long reaches no bound
    least = -(1 << 63)
    value, bound = F.coalesce("value", F.lit(least)), F.when(F.col("bound").isNotNull(), F.greatest("bound", F.lit(least + 1)))
    values = rows.select(*group, "pos", value.alias("value"), bound.alias("bound"))
    blocks = written(_packed(values, group, ["value", "bound"], size), "blocks")
    tree: list[DataFrame] = []  # tree[l]: nodes and the maxima of their children, which are blocks at level 0
    below = blocks.select(*group, F.col("block").alias("node"), F.array_max("value").alias("value"))
    while not tree or tree[-1].where("block > 0").limit(1).count():
        tree.append(written(_packed(below.withColumnRenamed("node", "pos"), group, ["value"], fan), "maxima"))
        below = tree[-1].select(*group, F.col("block").alias("node"), F.array_max("value").alias("value"))
    asked = blocks
    for level, nodes in enumerate(tree):
        beside = _renamed(nodes, group, f"__{level}_", **{f"__node_{level}": F.col("block"), f"__maxima_{level}": F.col("value")})
        asked = asked.join(beside, _on(group, f"__{level}_", F.expr(f"block div {fan ** (level + 1)}") == F.col(f"__node_{level}")))
    asked = asked.select(*group, "block", "value", "bound", *[f"__maxima_{level}" for level in range(len(tree))])
    kinds = [blocks.schema[c] for c in group]
    packs = T.StructType([*kinds, *T.StructType.fromDDL("level int, node long, places array<long>, found array<long>").fields])
    first = written(asked.mapInArrow(_search_blocks(group, len(tree), size, fan), packs), "searched")
    answers, questions = first.where("level = -1"), first.where("level >= 0")
    for level in range(len(tree) - 1, -1, -1):
        nodes = blocks.select(*group, "block", "value") if level == 0 else tree[level - 1]
        at = _renamed(nodes, group, "__n_", __node=F.col("block"), __value=F.col("value"))
        sent = questions.where(F.col("level") == level).join(at, _on(group, "__n_", F.col("node") == F.col("__node")))
        found = sent.select(*group, "node", "places", "found", "__value").mapInArrow(_descend(group, level, fan if level else size), packs)
        if level:
            questions = written(questions.where(F.col("level") < level).unionByName(found), "searched")
        else:
            answers = answers.unionByName(found)
    pairs = answers.select(*group, F.explode(F.arrays_zip(F.col("places").alias("pos"), F.col("found").alias("end"))).alias("x"))
    return pairs.select(*group, "x.pos", F.when(F.col("x.end") >= 0, F.col("x.end")).alias("end"))


def _exits(group: list[str], size: int):
    """For each block, the distinct places outside it that jumps from it lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, types = _keys(batch, group)
            out = _Out(group)
            for i, key in enumerate(keys):
                first = batch.column(len(group))[i].as_py() * size
                exits = np.unique(_leaving(_numbers(batch.column(len(group) + 1), i), first))
                out.add(key, 0, 0, exits, exits)
            yield out.batch(types)

    return run


def _leaving(jumps: np.ndarray, first: int) -> np.ndarray:
    """Where the chain from each place of a block leaves it."""
    at, end = jumps.copy(), first + len(jumps)
    for _ in range(len(jumps).bit_length()):
        inside = at < end
        if not inside.any():
            break
        at[inside] = at[at[inside] - first]
    return at


def _walk(group: list[str], size: int, whole: bool):
    """From the places that enter a block: the places that their chains visit in it (``whole``), or where they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = len(group)
        for batch in batches:
            keys, types = _keys(batch, group)
            out = _Out(group)
            for i, key in enumerate(keys):
                first = batch.column(g)[i].as_py() * size
                jumps, places = _numbers(batch.column(g + 1), i), _numbers(batch.column(g + 2), i)
                places = places[places < first + len(jumps)]  # a jump may lead beyond the last row
                if not whole:
                    out.add(key, 0, 0, places, _leaving(jumps, first)[places - first])
                    continue
                visited, steps = [], jumps.tolist()
                for here in places.tolist():
                    while here < first + len(steps):
                        visited.append(here)
                        here = steps[here - first]
                out.add(key, 0, 0, np.array(visited), np.array(visited))
            yield out.batch(types)

    return run


def chain(jumps: DataFrame, group: list[str], size: int = ROWS) -> DataFrame:
    """``group, pos``: the places that a chain of jumps from place 0 of each group visits.

    ``jumps`` has ``pos`` (from 0 without gaps) and ``next`` (a later place; one beyond the last row ends the chain).  Chains are contracted to where they
    enter blocks, and the entries that the chain from 0 uses are found by doubling: as many joins as the number of blocks has binary digits.
    """
    blocks = written(_packed(jumps, group, ["next"], size), "jumps")
    kinds = [blocks.schema[c] for c in group]
    packs = T.StructType([*kinds, *T.StructType.fromDDL("level int, node long, places array<long>, found array<long>").fields])
    start = blocks.where("block = 0").select(*group, F.lit(0).cast("long").alias("pos"))

    def entered(entries: DataFrame, whole: bool) -> DataFrame:
        """``pos, next`` of entries and where their chains leave their block, or every place they visit."""
        at = entries.groupBy(*group, F.expr(f"pos div {size}").alias("block")).agg(F.collect_set("pos").alias("places"))
        at = _renamed(at, group, "__e_", __block=F.col("block"), places=F.col("places"))
        joined = blocks.join(at, _on(group, "__e_", F.col("block") == F.col("__block"))).select(*group, "block", "next", "places")
        out = joined.mapInArrow(_walk(group, size, whole), packs)
        return out.select(*group, F.explode(F.arrays_zip(F.col("places").alias("pos"), F.col("found").alias("next"))).alias("x")).select(*group, "x.*")

    last = blocks.agg(F.max("block")).first()[0] or 0
    reached = start
    if last:
        exits = blocks.select(*group, "block", "next").mapInArrow(_exits(group, size), packs).select(*group, F.explode("places").alias("pos"))
        steps = [written(entered(exits.unionByName(start).distinct(), False), "steps")]

        def onward(rows: DataFrame, place: str, step: DataFrame) -> DataFrame:
            return rows.join(_renamed(step, group, "__s_", __pos=F.col("pos"), __next=F.col("next")), _on(group, "__s_", F.col(place) == F.col("__pos")))

        while 1 << len(steps) <= last:
            steps.append(written(onward(steps[-1], "next", steps[-1]).select(*group, "pos", F.col("__next").alias("next")), "steps"))
        for step in reversed(steps):
            reached = written(reached.unionByName(onward(reached, "pos", step).select(*group, F.col("__next").alias("pos"))).distinct(), "reached")
    return entered(reached, True).select(*group, "pos")
