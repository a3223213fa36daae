"""Counters of a run, observed in the pass that does the work: no second job, in batch and in streams."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .route import URGENT_MAIN, urgent

NAME = "messages"


def counters(threshold: float = 0.7) -> list[Column]:
    """total, kept, archived, urgent, needs_review and errors of decided messages; those with an error count as nothing else."""
    ok = F.col("error").isNull()
    keep = F.col("stay_in_inbox")
    return [F.count(F.lit(1)).alias("total"), F.count_if(ok & keep).alias("kept"), F.count_if(ok & ~keep).alias("archived"), F.count_if(ok & urgent(URGENT_MAIN)).alias("urgent"), F.count_if(ok & keep & (F.col("score") < threshold)).alias("needs_review"), F.count_if(~ok).alias("errors")]


def observed(decided: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, Observation]:
    """(decided, its counters): the counters are there once the rows have been written or counted."""
    watch = Observation(NAME)
    return decided.observe(watch, *counters(threshold)), watch


def watched(stream: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A stream whose batches tell a Progress listener their counters."""
    return stream.observe(NAME, *counters(threshold))


class Progress(StreamingQueryListener):
    """Sums the counters of all batches, and notes each batch: (batch, counters)."""

    def __init__(self) -> None:
        self.total: Counter = Counter()
        self.batches: list[tuple[int, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.batches.append((event.progress.batchId, row.asDict()))
            self.total.update(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
