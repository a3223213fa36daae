"""A model as a stage: equal prompts are asked once, replies are kept by the prompt's hash, one failed prompt is one row's error.

`ask` maps a list of prompts to as many replies. It runs in the tasks; a call that raises, or gives another number of
replies, is made again prompt by prompt, and what still raises, or takes longer than the time limit, is the error
of that prompt alone. Errors are not kept, so that a later run asks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import stored

Ask = Callable[[list[str]], list[str]]
SCHEMA = "key string, reply string"
#: Prompts of one call, and seconds that a call for one prompt may take.
CALL, SECONDS = 16, 120.0


class _Caller:
    """Calls under a time limit. A call that is late is left to its thread, and the next one has a thread of its own."""

    def __init__(self, ask: Ask, seconds: float) -> None:
        self.ask, self.seconds, self.pool = ask, seconds, ThreadPoolExecutor(1)

    def call(self, prompts: list[str]) -> list[str]:
        try:
            got = self.pool.submit(self.ask, prompts).result(self.seconds * len(prompts))
        except Late:
            self.pool.shutdown(wait=False, cancel_futures=True)
            self.pool = ThreadPoolExecutor(1)
            raise TimeoutError(f"no reply within {self.seconds * len(prompts):g} seconds") from None
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
        return got

    def each(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(reply, error) of each prompt."""
        try:
            return [(r, None) if r is not None else (None, "no reply") for r in self.call(prompts)]
        except Exception as e:  # noqa: BLE001  whatever a model raises is the prompt's error
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        return [x for p in prompts for x in self.each([p])]


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def answered(rows: DataFrame, ask: Ask, path: str | None = None, column: str = "prompt", call: int = CALL, seconds: float = SECONDS) -> DataFrame:
    """rows with reply and error; of a null prompt both are null. path: where replies are kept from run to run.

    Distinct prompts alone are shuffled to the tasks that call, under the SHA-256 of their text.
    """
    key = F.sha2(F.col(column), 256)
    prompts = rows.filter(F.col(column).isNotNull()).groupBy(key.alias("key")).agg(F.first(column).alias("prompt"))
    known = kept(rows.sparkSession, path) if path else None
    if known is not None:
        known = known.groupBy("key").agg(F.first("reply").alias("reply"))
        prompts = prompts.join(known.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = _Caller(ask, seconds)
        for b in batches:
            texts = b.column("prompt").to_pylist()
            got = [x for k in range(0, len(texts), call) for x in caller.each(texts[k : k + call])]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["key", "reply", "error"])

    # written once: neither a second reader nor a lost executor elsewhere asks again
    new = stored(prompts.mapInArrow(run, f"{SCHEMA}, error string"), "replies")
    if path:
        new.filter("error IS NULL").select("key", "reply").write.mode("append").parquet(path)
    every = new if known is None else new.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    every = every.select(F.col("key").alias("_key"), "reply", "error")
    return rows.join(every, key == F.col("_key"), "left").drop("_key")
