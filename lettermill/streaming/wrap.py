"""The transformers keep no state, so a stream of messages runs through them as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.mail import MESSAGE


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE).json(path)


def write(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """All there is, once, then it ends; the next call goes on from the checkpoint."""
    return transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
