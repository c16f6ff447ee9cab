"""A streaming source that tails log files that grow.

Spark's file source reads a file once; this one remembers a byte position per file.  Offsets are kept in the query's
checkpoint, so a restart goes on where it stopped.  Only whole lines are emitted: a position advances past the last
line end and no further.  A file that became shorter starts a new generation and is read from its begin.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one partition reads.
CHUNK = 16 << 20


class _Range(InputPartition):
    def __init__(self, path: str, generation: int, start: int, stop: int):
        self.path, self.generation, self.start, self.stop = path, generation, start, stop


def _last_line_end(path: str, start: int, size: int) -> int:
    """Just past the last line end in [start, size), or ``start``."""
    stop = size
    with open(path, "rb") as f:
        while stop > start:
            begin = max(start, stop - (1 << 16))
            f.seek(begin)
            at = f.read(stop - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            stop = begin
    return start


class TailReader(DataSourceStreamReader):
    """Offsets map each path to [generation, position].  The folder is one that driver and executors share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = int(options.get("chunkBytes", CHUNK))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(os.path.join(self.path, "*.log"))):
            generation, position = self.known.get(path, [0, 0])
            size = os.path.getsize(path)
            if size < position:
                generation, position = generation + 1, 0
            self.known[path] = [generation, _last_line_end(path, position, size)]
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        for path, at in before.items():  # after a restart
            self.known.setdefault(path, at)
        out: list[InputPartition] = []
        for path, (generation, stop) in after.items():
            old, position = before.get(path, [0, 0])
            position = position if old == generation else 0
            for begin in range(position, stop, self.chunk):
                out.append(_Range(path, generation, begin, min(stop, begin + self.chunk)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Lines that begin within the partition's bytes."""
        with open(partition.path, "rb") as f:
            here = partition.start
            f.seek(max(0, here - 1))
            if here and f.read(1) != b"\n":
                here += len(f.readline())
            while here < partition.stop:
                line = f.readline()
                if not line:
                    break
                yield partition.path, partition.generation, here, line.rstrip(b"\r\n").decode("utf-8", "replace")
                here += len(line)


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(folder)``: log_file, generation, position, line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "log_file string, generation long, position long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the ``tail`` format known to a session."""
    spark.dataSource.register(TailSource)
