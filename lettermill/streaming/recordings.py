"""Recorded answers as a stream: keyed state holds the last answer of each signature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.mail import SIGNATURE

_ANSWER = "recorded_at string, category string, score double, response string"
_OUT = "id string, subject string, snippet string, `from` string, category string, score double, response string, recorded_at string"


def _order(answer: tuple) -> tuple:
    """As mail.keep_last orders answers: nulls before all else, then value by value."""
    return tuple((x is not None, x if x is not None else 0) for x in answer)


class _Last(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("answer", _ANSWER)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.state.get()) if self.state.exists() else None
        best = before
        for frame in rows:
            for row in frame[["recorded_at", "category", "score", "response"]].itertuples(index=False):
                answer = tuple(None if pd.isna(x) else x for x in row)
                if best is None or _order(answer) > _order(best):
                    best = answer
        if best != before:
            self.state.update(best)
            yield pd.DataFrame([dict(zip(SIGNATURE, key, strict=True)) | dict(zip(("recorded_at", "category", "score", "response"), best, strict=True))])[["id", "subject", "snippet", "from", "category", "score", "response", "recorded_at"]]

    def close(self) -> None:
        pass


def latest(recordings: DataFrame) -> DataFrame:
    """A stream of the answers that take the place of an earlier one, or are a signature's first: the last row of each signature is what mail.keep_last gives. Needs the RocksDB state store."""
    whole = recordings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SIGNATURE], "recorded_at", "category", F.col("score").cast("double").alias("score"), "response")
    return whole.groupBy(*SIGNATURE).transformWithStateInPandas(_Last(), _OUT, "Update", "None")
