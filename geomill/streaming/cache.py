"""A cache of answers as state of a stream, with entries that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind needs this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ExpiringCache(StatefulProcessor):
    """Keeps when each key was asked last; the state store drops it after ``seconds``."""

    def __init__(self, key: str, kind: str, seconds: float):
        self.key, self.kind, self.seconds = key, kind, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "asked timestamp", int(self.seconds * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for part in rows for t in part["time"])
        asked = self.entry.get()[0] if self.entry.exists() else None
        out = []
        for t in times:
            hit = asked is not None and (t - pd.Timestamp(asked)).total_seconds() <= self.seconds
            if not hit:
                asked = t
            out.append((key[0], t, hit))
        self.entry.update((pd.Timestamp(asked).to_pydatetime(),))
        yield pd.DataFrame(out, columns=[self.key, "time", "hit"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, time, hit): requests (key, time) of a stream, each a hit where its key was asked for at most ``seconds`` before.

    A request that is no hit asks anew, and the entry counts from then.  Within
    a batch requests go by time.  Entries that have been in the store for
    ``seconds`` are dropped by it, so state holds live keys alone.
    """
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, "time")
    return rows.groupBy(key).transformWithStateInPandas(ExpiringCache(key, kind, seconds), f"`{key}` {kind}, time timestamp, hit boolean", "Append", "ProcessingTime")
