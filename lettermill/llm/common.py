"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; whole texts vary from nothing to megabytes.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns; whatever else docs holds stays behind."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c) for c in more])


def residue(mod: int) -> Column:
    """crc32 of doc_id as text, mod `mod`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors. rows: about how many it has; few rows are made by fewer tasks."""
    if rows is not None:
        df = df.coalesce(max(24, rows // 2000))
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    columns = [pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, x in enumerate(schema.split(", "))]
    return spark.createDataFrame(pa.table(columns, names=names))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fraction_at_most(df: DataFrame, rows: int) -> Column:
    """A predicate that keeps about `rows` rows of df, chosen by a hash of doc_id; all, if there are no more."""
    n = df.count()
    share = 1 << 30 if n <= rows else int((1 << 30) * rows / n)
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 30)) < F.lit(share)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array and its offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
