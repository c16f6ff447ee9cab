"""Exact trailing-window features of a stream, in arrival order.

A new event first removes what is not within the window before its own time, and the removal is permanent; so an event that arrives late may count
rows in its future and misses rows that were removed.  ``operators/features.py`` has the same counts in batch.

A key's state is spread over slices of time: a map of the number of held times by slice, and a map of the times themselves.  A batch reads
and writes the slices that its events fall into or cut, not the window; whole slices leave by their number alone.  The rows of a key that come
in one batch are sorted by runs in a temporary file where they are many, and counted a piece at a time.  Queries are started by
``state.started``.
"""

from __future__ import annotations

import bisect
import tempfile
import time
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallylog.operators.features import WINDOW_SECONDS
from tallylog.operators.parsing import event_code

#: Slices of time in a window.
SLICES = 256
#: Rows of a batch that a key sorts in memory, and rows of each sorted run that are merged at a time.
SORTED_ROWS, MERGED_ROWS = 1 << 20, 1 << 14

_ROW = np.dtype([("seq", "<i8"), ("us", "<i8"), ("flagged", "?")])


def _sorted(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate([np.empty(0, _ROW), *parts])
    return rows[np.argsort(rows["seq"], kind="stable")]


def _merged(file: BinaryIO, sizes: list[int]) -> Iterator[np.ndarray]:
    """The sorted runs of a file as one, in pieces."""
    ends = np.cumsum(sizes).tolist()
    at = [end - size for end, size in zip(ends, sizes)]
    ahead = [np.empty(0, _ROW) for _ in sizes]  # read and not yet given
    while True:
        for i, end in enumerate(ends):
            if not len(ahead[i]) and at[i] < end:
                n = min(MERGED_ROWS, end - at[i])
                file.seek(at[i] * _ROW.itemsize)
                ahead[i] = np.frombuffer(file.read(n * _ROW.itemsize), _ROW)
                at[i] += n
        lasts = [rows["seq"][-1] for rows in ahead if len(rows)]
        if not lasts:
            return
        # no run has an unread row before its last one read
        cuts = [int(np.searchsorted(rows["seq"], min(lasts), side="right")) for rows in ahead]
        yield _sorted([rows[:cut] for rows, cut in zip(ahead, cuts)])
        ahead = [rows[cut:] for rows, cut in zip(ahead, cuts)]


def by_arrival(frames: Iterable[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Rows of frames of seq, us and flagged in the order of ``seq``, in pieces; memory holds SORTED_ROWS of them whatever their number."""
    held: list[np.ndarray] = []
    sizes: list[int] = []
    with tempfile.SpooledTemporaryFile(max_size=1) as file:  # a file from the first run on
        for pdf in frames:
            part = np.empty(len(pdf), _ROW)
            for name in _ROW.names:
                part[name] = pdf[name].to_numpy()
            held.append(part)
            if sum(map(len, held)) >= SORTED_ROWS:
                sizes.append(sum(map(len, held)))
                file.write(_sorted(held).tobytes())
                held = []
        last = _sorted(held)
        if sizes:
            file.write(last.tobytes())
            yield from _merged(file, [*sizes, len(last)])
        else:
            yield from (last[i : i + MERGED_ROWS] for i in range(0, len(last), MERGED_ROWS))


class _Counter(StatefulProcessor):
    """Trailing counts for one key; ``count_others`` also gives the count to rows that are not flagged."""

    def __init__(self, seconds: float, idle_ms: int | None, count_others: bool):
        self.width, self.idle_ms, self.count_others = int(round(seconds * 1e6)), idle_ms, count_others
        self.slice = max(1, self.width // SLICES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "slice long", "n long")
        self.times = handle.getMapState("times", "slice long", "us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sizes = {k[0]: v[0] for k, v in self.sizes.iterator()}
        order, total = sorted(sizes), sum(sizes.values())
        held: dict[int, list[int]] = {}  # sorted times of the slices that this batch touches
        touched: set[int] = set()

        def opened(at: int) -> list[int]:
            if at not in held:
                held[at] = list(self.times.getValue((at,))[0]) if at in sizes else []
            touched.add(at)
            return held[at]

        for came in by_arrival(rows):
            counts = []
            for us, flagged in zip(came["us"].tolist(), came["flagged"].tolist()):
                if flagged:
                    at = us // self.slice
                    bisect.insort(opened(at), us)
                    if at not in sizes:
                        bisect.insort(order, at)
                    sizes[at] = sizes.get(at, 0) + 1
                    total += 1
                if not flagged and not self.count_others:
                    counts.append(0)
                    continue
                limit = us - self.width
                while order and order[0] <= limit // self.slice:
                    first = order[0]
                    if (first + 1) * self.slice - 1 <= limit:  # all of the slice goes
                        gone = sizes[first]
                        held[first] = []
                        touched.add(first)
                    else:
                        here = opened(first)
                        gone = bisect.bisect_right(here, limit)
                        del here[:gone]
                    total -= gone
                    sizes[first] -= gone
                    if sizes[first]:
                        break
                    del sizes[first]
                    order.pop(0)
                counts.append(total)
            yield pd.DataFrame({"seq": came["seq"], "n": np.array(counts, "int64")})
        for at in touched:
            if held[at]:
                self.times.updateValue((at,), (held[at],))
                self.sizes.updateValue((at,), (sizes[at],))
            elif self.sizes.containsKey((at,)):
                self.times.removeKey((at,))
                self.sizes.removeKey((at,))
        if self.idle_ms:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(int(time.time() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sizes.clear()
        self.times.clear()
        yield pd.DataFrame({"seq": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def _counted(events: DataFrame, key: list[str], flag: str, seconds: float, idle_ms: int | None, count_others: bool) -> DataFrame:
    rows = events.select(*key, "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col("event_type") == flag, F.lit(False)).alias("flagged"))
    counter = _Counter(seconds, idle_ms, count_others)
    return rows.groupBy(*key).transformWithStateInPandas(counter, "seq long, n long", "append", "ProcessingTime" if idle_ms else "None")


def login_counts(events: DataFrame, seconds: float = WINDOW_SECONDS, idle_ms: int | None = None) -> DataFrame:
    """seq, n: the user's logins in the window at each event, 0 for other events.

    ``idle_ms`` drops the state of users that were silent so long; without it state is kept.
    """
    users = events.withColumn("user", F.coalesce("user", F.lit("")))
    return _counted(users, ["user"], "login", seconds, idle_ms, False)


def error_counts(events: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """seq, n: service errors of everyone in the window at each event.

    The exact rule depends on the order of all events, so this is one key and one task.  For long histories use the batch
    features, which are spread over time and agree where events arrive in time order.
    """
    return _counted(events.withColumn("all", F.lit(0)), ["all"], "service_error", seconds, None, True)


def windowed_errors(events: DataFrame, late: str, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """window, n: service errors in sliding windows, with events later than ``late`` left out."""
    errors = events.where("event_type = 'service_error'").withWatermark("ts", late)
    return errors.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))


def coded(events: DataFrame) -> DataFrame:
    """Add event_type_code."""
    return events.withColumn("event_type_code", event_code(F.col("event_type")))
