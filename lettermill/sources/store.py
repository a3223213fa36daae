"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from urllib.parse import urlparse

import pyarrow.fs as afs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        at = tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def folder(uri: str) -> tuple[afs.FileSystem, str]:
    """A folder's file system and its path there, for what tasks read and write themselves; s3a is s3 to Arrow."""
    return afs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if urlparse(uri).scheme else (afs.LocalFileSystem(), uri)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, made once: what follows reads it again instead of making it again."""
    at = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with a running number by `order`. Rows are dealt by ranges of `order` and counted there; the window is over the ranges alone."""
    dealt = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + place + first).alias(name))
