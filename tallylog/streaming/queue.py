"""Queues in order: a stream of numbered records, however they arrive, becomes each queue's records without gaps, repeats or disorder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers whose waiting records share an entry of state.
RUN = 16_384


def _joined(parts: list[pa.Table]) -> pa.Table:
    """The records of all parts by number, of repeats the first."""
    table = pa.concat_tables(parts)
    _, first = np.unique(table["seq"].to_numpy(), return_index=True)
    return table.take(pa.array(first))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_all()


class _Reorder(StatefulProcessor):
    """State of a queue: the next number to give out, and records that wait for earlier ones, an entry for each RUN of numbers.

    A batch reads and writes an entry for each run that it has records of, whatever the number of records.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.waiting = handle.getMapState("waiting", "run long", "records binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else 0
        schema = pa.schema({"seq": pa.int64(), "value": pa.string()})
        parts = [schema.empty_table()]
        for pdf in rows:
            pdf = pdf[pdf["seq"] >= due]
            parts.append(pa.table([pa.array(pdf["seq"], pa.int64()), pa.array(pdf["value"], pa.string(), from_pandas=True)], schema=schema))
        came = _joined(parts)
        del parts
        runs, begin = np.unique(came["seq"].to_numpy() // RUN, return_index=True)
        end = np.append(begin[1:], len(came))
        mine = {run: came.slice(b, e - b) for run, b, e in zip(runs.tolist(), begin.tolist(), end.tolist())}
        # runs upwards; where the last number of one is given out, the next follows, which may have waiting records only
        left = sorted(mine, reverse=True)
        while left:
            run = left.pop()
            here = [mine.pop(run)] if run in mine else []
            held = self.waiting.containsKey((run,))
            if held:  # of repeats the one that came in an earlier batch stays
                here.insert(0, _unpacked(self.waiting.getValue((run,))[0]))
            if not here:
                continue
            table = _joined(here)
            ready = 0
            if run == due // RUN:
                numbers = table["seq"].to_numpy()
                ready = int((numbers == due + np.arange(len(numbers))).sum())
                due += ready
            if ready < len(table):
                if ready or run in runs:
                    self.waiting.updateValue((run,), (_packed(table.slice(ready).combine_chunks()),))
            elif held:
                self.waiting.removeKey((run,))
            if ready:
                yield _given(key[0], table.slice(0, ready))
                if due // RUN == run + 1 and (not left or left[-1] != run + 1):
                    left.append(run + 1)
        self.next.update((due,))
        yield _given(key[0], schema.empty_table())

    def close(self) -> None:
        pass


def _given(queue: str, table: pa.Table) -> pd.DataFrame:
    seq, value = table["seq"].to_numpy(), table["value"].to_pandas().astype(object)
    return pd.DataFrame({"queue": pd.Series([queue] * len(seq), dtype=object), "seq": seq, "value": value})


def in_order(records: DataFrame) -> DataFrame:
    """queue, seq, value of a stream of such: each queue's numbers from 0 on, each once, a number after all before it.

    A record waits in the state until those before it have come; its value is kept as it came first.  Rows without a queue or a number are left out.
    Start the query by ``state.started``, which sets the state store that this needs.
    """
    rows = records.where("queue is not null and seq is not null").select("queue", "seq", "value")
    return rows.groupBy("queue").transformWithStateInPandas(_Reorder(), "queue string, seq long, value string", "append", "None")
