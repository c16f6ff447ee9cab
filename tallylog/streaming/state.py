"""Starting streams with keyed state."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(writer: DataStreamWriter) -> StreamingQuery:
    """Start a query with the state store that keyed state needs; a query keeps the setting it was started with."""
    conf = writer._spark.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
