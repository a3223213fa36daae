"""Spans in text, in the JVM: matches with their positions, overlaps within a row, overlaps across rows as a join.

A span is (pii_type, text, start, end), in characters. Positions come from splitting the text at the matches: a match
begins after all gaps and matches before it. Whatever is folded over spans is folded within groups of spans that
overlap, which a sweep along their starts finds, so a text with many spans costs no square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "struct<pii_type:string,text:string,start:bigint,end:bigint>"
Rule = Callable[[Column, Column], Column]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def places(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches of a pattern that matches no empty text; classes and word boundaries are Unicode's."""
    p = f"(?U){pattern}"
    pairs = lambda hits: F.zip_with(hits, F.slice(F.split(text, p, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), F.length(g).cast("long").alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.length(x["hit"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("pii_type"), x["hit"].alias("text"), start.alias("start"), end.alias("end")))).alias("out"), end.alias("at"))

    begin = F.struct(none().alias("out"), F.lit(0).cast("long").alias("at"))
    return bound(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda hits: F.aggregate(pairs(hits), begin, step)["out"])


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def longer(new: Column, old: Column) -> Column:
    return F.octet_length(new["text"]) > F.octet_length(old["text"])


def _folded(spans: Column, wins: Rule) -> Column:
    """Each in turn: appended, or in place of the first that it overlaps if it wins."""

    def step(acc: Column, s: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda o: overlap(s, o)), True)
        put = lambda k: F.when(k == 0, F.concat(acc, F.array(s))).when(wins(s, F.get(acc, (k - 1).cast("int"))), F.transform(acc, lambda o, i: F.when(i == k - 1, s).otherwise(o))).otherwise(acc)
        return bound(first, put)

    return F.aggregate(spans, none(), step)


def _groups(spans: Column) -> Column:
    """Arrays of (start, place, span) that overlap in a chain, from such structs sorted by start."""
    one = lambda x: F.array(x)
    begin = F.struct(F.slice(F.array(F.slice(spans, 1, 0)), 1, 0).alias("done"), F.slice(spans, 1, 0).alias("open"), F.lit(-1).cast("long").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        joins = x["start"] < acc["end"]
        full = F.when(joins | (F.size(acc["open"]) == 0), acc["done"]).otherwise(F.concat(acc["done"], one(acc["open"])))
        return F.struct(full.alias("done"), F.when(joins, F.concat(acc["open"], one(x))).otherwise(one(x)).alias("open"), F.greatest(acc["end"], x["span"]["end"]).alias("end"))

    return F.aggregate(spans, begin, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], one(acc["open"]))).otherwise(acc["done"]))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def settled(found: Column, wins: Rule = longer, in_order: bool = True) -> Column:
    """Overlaps settled: each span in the order found (in_order) or by start is kept, or put in place of the first that it overlaps and wins over."""
    placed = F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), i.alias("place"), s.alias("span")))
    order = (lambda g: F.array_sort(F.transform(g, lambda x: F.struct(x["place"].alias("place"), x["span"].alias("span"))))) if in_order else (lambda g: g)
    grouped = bound(F.array_sort(placed), _groups)
    out = F.flatten(F.transform(grouped, lambda g: F.when(F.size(g) == 1, F.array(g[0]["span"])).otherwise(_folded(F.transform(order(g), lambda x: x["span"]), wins))))
    return F.when(F.size(found) < 2, found).otherwise(by_start(out) if in_order else out)


def add_apart(spans: Column, more: Column) -> Column:
    """spans and those of `more` (which don't overlap one another) that overlap none of them."""
    return F.when(F.size(more) == 0, spans).otherwise(F.concat(spans, F.filter(more, lambda c: ~F.exists(spans, lambda o: overlap(c, o)))))


# --- across rows ---
def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int = 64) -> DataFrame:
    """Pairs of spans (start, end; columns of right with a 2) of one key that overlap.

    Each span goes to every bucket of `width` places that it touches, so a text of any length is dealt out by its
    buckets; a pair is found in the bucket where the later of the two begins, and in no other. Long spans cost one row
    a bucket. Null keys meet nothing; empty spans overlap what they lie strictly within.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    last = F.greatest(F.floor((F.col("end") - 1) / width), bucket("start"))
    dealt = lambda df: df.withColumn("_bucket", F.explode(F.sequence(bucket("start"), last)))
    second = dealt(right)
    second = second.select(*[F.col(c).alias(c if c in (*key, "_bucket") else f"{c}2") for c in second.columns])
    pairs = dealt(left).join(second, [*key, "_bucket"])
    return pairs.filter((F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")) & (F.floor(F.greatest("start", "start2") / width) == F.col("_bucket"))).drop("_bucket")


def overlap_groups(spans: DataFrame, key: list[str], name: str = "group") -> DataFrame:
    """spans (start, end) with the number, from 1, of their chain of overlaps within the key: a new one begins where all earlier spans have ended."""
    w = Window.partitionBy(*key).orderBy("start", F.desc("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), 1).otherwise(0)
    return spans.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
