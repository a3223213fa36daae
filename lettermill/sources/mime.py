"""Messages as a mailbox gives them (JSON text: id, snippet, payload of headers, body and nested parts) to rows, in the JVM.

The text is parsed once, to a VARIANT. Parts may be nested to any depth: each level is one pass over the messages that have
parts on it, and each part has a place that sorts as a reader would meet it: a list's plain parts in turn, each with what
is nested in it, then the list's HTML. The first place with a body is the message's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html
from .store import stored


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _utf8(data: Column) -> Column:
    """Bytes as text, null unless they are UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def _decoded(data: Column) -> Column:
    """URL-safe base64 with its padding, as UTF-8; null for anything else."""
    fits = data.rlike("^[A-Za-z0-9_-]*={0,2}$") & (F.length(data) % 4 == 0)
    return _utf8(F.when(fits, F.unbase64(F.translate(data, "-_", "+/"))))


def _data(node: Column) -> Column:
    """A body's data as (text, encoded): JSON text is UTF-8 as it stands; bytes that are none come as {"hex": ...}."""
    raw = F.unhex(_text(node, "$.body.data.hex"))
    return F.struct(F.coalesce(_utf8(raw), F.when(raw.isNull(), _text(node, "$.body.data"))).alias("text"), F.coalesce(_text(node, "$.body.data"), F.decode(raw, "iso-8859-1")).alias("encoded"))


def _plain(node: Column) -> Column:
    """The data as it is, else decoded."""
    data = _data(node)
    whole = F.schema_of_variant(F.variant_get(node, "$.body.data", "variant")) == "OBJECT<hex: STRING>"
    return F.when(F.coalesce(whole, F.lit(False)), F.coalesce(data["text"], _decoded(data["encoded"]))).otherwise(_text(node, "$.body.data"))


def bodies(messages: DataFrame) -> DataFrame:
    """_n, body of the parts of messages (_n, payload: variant); messages whose parts have none are left out."""
    spark = messages.sparkSession
    prefix = F.array().cast("array<int>")
    level = messages.select("_n", prefix.alias("place"), F.try_variant_get("payload", "$.parts", "array<variant>").alias("parts")).filter("size(parts) > 0")
    found = None
    while True:
        parts = stored(level.select("_n", "place", F.posexplode("parts").alias("k", "part")).select("_n", "place", "k", F.col("part").alias("part")), "parts")
        kind = _text(F.col("part"), "$.mimeType")
        at = lambda a, b: F.concat("place", F.array(F.lit(a), F.col("k"), F.lit(b)))
        plain = F.when(kind == "text/plain", _plain(F.col("part")))
        html = F.when(kind == "text/html", strip_html(_decoded(_data(F.col("part"))["encoded"])))
        here = parts.select("_n", F.explode(F.array(F.struct(at(0, 0).alias("place"), plain.alias("body")), F.struct(at(1, 0).alias("place"), html.alias("body")))).alias("x")).filter("x.body IS NOT NULL").select("_n", "x.place", "x.body")
        found = here if found is None else found.unionByName(here)
        level = stored(parts.select("_n", at(0, 1).alias("place"), F.try_variant_get("part", "$.parts", "array<variant>").alias("parts")).filter("size(parts) > 0"), "level")
        if level.isEmpty():
            return found.groupBy("_n").agg(F.min_by("body", "place").alias("body"))


def parse_messages(df: DataFrame, column: str = "raw") -> DataFrame:
    """The columns of MESSAGE and error, one row for each row of df; a row that can't be read has id `unknown`, an error and nothing else."""
    read = F.try_parse_json(column)
    whole = F.when(F.schema_of_variant(read).startswith("OBJECT"), read)
    rows = stored(df.select(F.monotonically_increasing_id().alias("_n"), whole.alias("m")).select("_n", "m", F.try_variant_get("m", "$.payload", "variant").alias("payload")), "raw")
    nested = bodies(rows.filter("payload IS NOT NULL")).withColumnsRenamed({"_n": "_k", "body": "_nested"})
    headers = F.coalesce(F.try_variant_get("payload", "$.headers", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    first = lambda name: F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]
    snippet = _text(F.col("m"), "$.snippet")
    to = F.transform(F.split(first("to"), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    body = F.coalesce("_nested", F.when(F.col("payload").isNotNull(), _plain(F.col("payload"))), snippet)
    got = rows.join(nested, F.col("_n") == F.col("_k"), "left")
    return got.select(F.coalesce(F.nullif(_text(F.col("m"), "$.id"), F.lit("")), F.lit("unknown")).alias("id"), first("subject").alias("subject"), snippet.alias("snippet"), first("from").alias("from"), to.alias("to"), first("date").alias("sent"), body.alias("body"), F.when(F.col("m").isNull(), F.lit("no message")).alias("error"))


def sent_at(df: DataFrame) -> DataFrame:
    """df with sent_ts from the header text in `sent`; null where it is no date."""
    plain = F.regexp_replace(F.regexp_replace("sent", r"^[A-Za-z]{3},[ ]*", ""), r"[ ]*[(][^)]*[)]$", "")
    return df.withColumn("sent_ts", F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z")))
