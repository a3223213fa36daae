"""Stand-ins for originals, kept as a table: one numbering over all fields of a run, which later runs carry on.

An original is the text of a span. Its seed is its place in the order in which originals are first seen; the first
type that is met counts. A kept dictionary is a Parquet table (text, pii_type, seed, stand_in); a run adds the originals
that it lacks, numbered after its greatest seed, and never changes what is there. One run at a time may add to a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fake
from ..sources.store import numbered, stored
from .spans import none

ENTRY = "struct<field:string,pii_type:string,original:string,stand_in:string,position:bigint>"
SCHEMA = "text string, pii_type string, seed long, stand_in string"


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The dictionary at path, None if there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fresh(found: DataFrame, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows of SCHEMA for the originals of found (text, pii_type and the columns of their order) that known lacks."""
    place = F.struct(*order)
    first = found.groupBy("text").agg(F.min(place).alias("_first"), F.min_by("pii_type", place).alias("pii_type"))
    begin = 0
    if known is not None:
        first = first.join(known.select("text"), "text", "left_anti")
        begin = known.agg(F.coalesce(F.max("seed") + 1, F.lit(0))).first()[0]
    made = numbered(stored(first, "originals"), ["_first"], "seed", begin)
    return made.select("text", "pii_type", "seed", fake.stand_in(F.col("pii_type"), F.col("text"), F.col("seed")).alias("stand_in"))


def extended(found: DataFrame, order: list[str], path: str) -> DataFrame:
    """The dictionary at path after the new originals of found are added to it."""
    spark = found.sparkSession
    known = kept(spark, path)
    fresh(found, order, known).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def of_fields(rows: DataFrame, entities: dict[str, str], order: tuple[str, ...] = ()) -> DataFrame:
    """_n, _field, _start, _end, text, pii_type of every span, and _o0, _o1, ... as `order` names them: entities names the column of spans of each text column."""
    of_field = lambda k, e: F.transform(F.coalesce(F.col(e), none()), lambda s: F.struct(F.lit(k).alias("field"), s.alias("s")))
    every = F.concat(*[of_field(k, e) for k, e in enumerate(entities.values())])
    places = [f"_o{k}" for k in range(len(order))]
    return rows.select("_n", *[F.col(c).alias(o) for c, o in zip(order, places, strict=True)], F.explode(every).alias("x")).select("_n", *places, F.col("x.field").alias("_field"), F.col("x.s.start").alias("_start"), F.col("x.s.end").alias("_end"), F.col("x.s.text").alias("text"), F.col("x.s.pii_type").alias("pii_type"))


def _written(text: Column, pieces: Column, field: str) -> Column:
    """(text with the stand-ins, what was replaced): spans that begin before the one before ends, or at whose place something else stands, are left."""
    nothing = F.array().cast("array<string>")
    log = F.array().cast(f"array<{ENTRY}>")
    begin = F.struct(nothing.alias("out"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("bytes"), log.alias("log"))

    def step(acc: Column, x: Column) -> Column:
        there = F.substring(text, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        fits = (x["start"] >= acc["at"]) & (there != "") & (F.contains(there, x["text"]) | F.contains(x["text"], there))
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        place = acc["bytes"] + F.octet_length(gap)
        entry = F.struct(F.lit(field).alias("field"), x["pii_type"].alias("pii_type"), x["text"].alias("original"), x["stand_in"].alias("stand_in"), place.alias("position"))
        new = F.struct(F.concat(acc["out"], F.array(gap, x["stand_in"])).alias("out"), x["end"].alias("at"), (place + F.octet_length(x["stand_in"])).alias("bytes"), F.concat(acc["log"], F.array(entry)).alias("log"))
        return F.when(fits, new).otherwise(acc)

    rest = lambda acc: F.struct(F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))).alias("text"), acc["log"].alias("log"))
    return F.aggregate(pieces, begin, step, rest)


def replaced(rows: DataFrame, entities: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """rows (with a number _n of their own) with stand-ins in each of the text columns, and `replacements`: field, pii_type, original, stand_in and position (bytes of the new text before it).

    Rows without spans stay out of the shuffle. An original that has no entry is left as it is.
    """
    some = F.lit(False)
    for e in entities.values():
        some = some | (F.coalesce(F.size(e), F.lit(0)) > 0)
    nothing = F.array().cast(f"array<{ENTRY}>")
    found = of_fields(rows.filter(some), entities).join(dictionary.select("text", "stand_in"), "text", "left")
    pieces = found.filter(F.col("stand_in").isNotNull()).groupBy("_n").agg(F.sort_array(F.collect_list(F.struct(F.col("_field").alias("field"), F.col("_start").alias("start"), F.col("_end").alias("end"), "text", "pii_type", "stand_in"))).alias("_pieces"))
    joined = rows.filter(some).join(pieces, "_n", "left").withColumn("_pieces", F.coalesce("_pieces", F.array().cast("array<struct<field:int,start:bigint,end:bigint,text:string,pii_type:string,stand_in:string>>")))
    columns = [c for c in rows.columns if c not in entities]
    of_field = lambda k: F.filter("_pieces", lambda x: x["field"] == k)
    joined = joined.withColumns({f"_w{k}": _written(F.col(c), of_field(k), c) for k, c in enumerate(entities)})
    done = joined.select(*columns, *[F.col(f"_w{k}.text").alias(c) for k, c in enumerate(entities)], F.flatten(F.array(*[F.coalesce(F.col(f"_w{k}.log"), nothing) for k in range(len(entities))])).alias("replacements"))
    return rows.filter(~some).withColumn("replacements", nothing).select(done.columns).unionByName(done)


def replacement_rate(done: DataFrame, entities: dict[str, str]) -> DataFrame:
    """detected, replaced, rate (whole per cent): spans, and those of them that have been replaced."""
    n = F.sum(sum((F.coalesce(F.size(e), F.lit(0)) for e in entities.values()), F.lit(0)).cast("long"))
    return done.agg(F.coalesce(n, F.lit(0)).alias("detected"), F.coalesce(F.sum(F.size("replacements").cast("long")), F.lit(0)).alias("replaced")).withColumn("rate", F.when(F.col("detected") > 0, F.floor(F.col("replaced") * 100 / F.col("detected"))))
