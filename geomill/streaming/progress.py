"""Counts that are known while a job or a stream runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress:
    """Named counts of the rows that pass a point of one job, known when it ends; a task that is run again counts once."""

    def __init__(self, name: str, total: int | None = None):
        self.observation, self.total = Observation(name), total

    def watch(self, rows: DataFrame, **counts: Column) -> DataFrame:
        """``rows``, observed: ``n`` and the given aggregates."""
        return rows.observe(self.observation, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items()))

    def counts(self) -> dict:
        """Waits for the job, and adds ``share`` of the total where it is known."""
        found = dict(self.observation.get)
        return found | ({"share": found["n"] / self.total} if self.total else {})


def watched(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """A stream whose batches report ``n`` and the given aggregates to a ``StreamProgress`` of that name."""
    return rows.observe(name, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items()))


class StreamProgress(StreamingQueryListener):
    """Sums over the batches of the queries in which ``watched`` has this name; a batch that is reported again counts once."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict:
        """The sum of each count so far."""
        out: dict = {}
        for counts in list(self.batches.values()):
            for k, v in counts.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
