"""Personal data that a model finds: prompts, replies, positions in the text, and the merge with what patterns find.

A model is a function from prompts to replies (see `model`); whatever it raises for a prompt becomes the error of the rows
with that prompt, and those rows have no entities. Positions are in characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import read_html
from ..sources.store import stored
from . import model, pii, spans, standins

Found = tuple[str, str]
Span = tuple[str, str, int, int]
NAME_WORDS, ADDRESS_WORDS = 50, 100
# What replies begin with, countries that models add, streets' endings, bounds, and the type that is more specific than another.
PREFIXES = ("JSON output:", "Here's the JSON:", "```json", "```", "JSON array:")
COUNTRIES = ("switzerland", "germany", "austria", "france")
STREETS = ("mann", "str", "weg")
MAX_BYTES, MAX_ARRAYS, MAX_PLACES, MAX_TEXT = 1 << 20, 100, 1000, 1_000_000
LESS = {("username", "email"), ("company", "email"), ("title", "name"), ("url", "email")}
_STRING = r'"(?:[^"\\]|\\.)*(?:"|\Z)'
STATS = {"email_patterns": 3, "phone_patterns": 2, "location_patterns": 5}


def name_prompt(text: str) -> str:
    return f'List every personal name in the text between the lines as a JSON array of strings, [] if there is none.\n---\n{text}\n---'


def address_prompt(text: str) -> str:
    return f'List every postal address in the text between the lines as a JSON array of strings, [] if there is none.\n---\n{text}\n---'


def clean_html(html: str) -> str:
    """Text of an HTML body without control characters, blanks collapsed."""
    return " ".join("".join(c for c in read_html(html) if c.isspace() or c.isprintable() or ord(c) > 159).split())


def prepare(text: str, n: int) -> str:
    """The first n words of the text, whatever they are."""
    return " ".join(clean_html(text).split()[:n])


def json_arrays(text: str) -> list[str]:
    """Outermost balanced arrays; brackets in strings don't count."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(rf"{_STRING}|[\[\]]", text.encode()[:MAX_BYTES].decode("utf-8", "ignore"), re.S):
        if m[0] == "[":
            begin = m.start() if not depth else begin
            depth += 1
        elif m[0] == "]" and depth:
            depth -= 1
            if not depth:
                out.append(text[begin : m.end()])
                if len(out) == MAX_ARRAYS:
                    break
    return out


def without_comments(text: str) -> str:
    return re.sub(rf"({_STRING})|//[^\n\r]*|/\*.*?(?:\*/|\Z)", lambda m: m[1] or "", text, flags=re.S)


def _parts(full: str) -> Iterator[Found]:
    """A name, its words, and the parts of those with a hyphen."""
    yield "name", full
    for word in full.split():
        if len(word.encode()) > 1:
            yield "name", word
            if "-" in word:
                yield from (("name", p) for p in word.split("-") if len(p.encode()) > 1)


def parse_reply(reply: str) -> list[Found]:
    """(type, text) of the first array that can be used; an empty array is a reply without names. Raises ValueError if there is none."""
    rest = reply.strip()
    for p in PREFIXES:
        rest = rest[len(p) :].strip() if rest.startswith(p) else rest
    rest = re.sub(r"(?:```)+\Z", "", rest).strip()
    for array in json_arrays(rest):
        try:
            got = json.loads(without_comments(array))
        except ValueError:
            continue
        if all(isinstance(x, str) for x in got):
            return [f for x in got for f in _parts(x)]
        if all(isinstance(x, dict) and isinstance(x.get("pii_type"), str) and isinstance(x.get("text"), str) for x in got):
            return [(x["pii_type"], x["text"]) for x in got]
        loose = [x for x in got if isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"]]
        if loose:
            kinds = [x["type"] if "type" in x else x.get("pii_type") for x in loose]
            return [(k if isinstance(k, str) else "unknown", x["text"]) for k, x in zip(kinds, loose, strict=True)]
    raise ValueError("no usable array in the reply")


def _keeps(old: Span, new: Span) -> bool:
    """Whether an older span stays where a new one overlaps it: a span that holds the other, the longer, the more specific, else the older."""
    if old[2] <= new[2] and old[3] >= new[3]:
        return True
    if new[2] <= old[2] and new[3] >= old[3]:
        return False
    a, b = len(old[1].encode()), len(new[1].encode())
    return a > b if a != b else (old[0], new[0]) not in LESS


def positions(text: str, found: list[Found]) -> list[Span]:
    """Every place of each, overlaps resolved."""
    text = text.encode()[:MAX_TEXT].decode("utf-8", "ignore")
    every: list[Span] = []
    for kind, what in found:
        if what:
            places = (m.start() for m in re.finditer(f"(?={re.escape(what)})", text))
            every += [(kind, what, p, p + len(what)) for _, p in zip(range(MAX_PLACES), places, strict=False)]
    out: list[Span] = []
    for s in sorted(every, key=lambda s: (s[2], -len(s[1].encode()))):
        rivals = [o for o in out if s[2] < o[3] and o[2] < s[3]]
        if not any(_keeps(o, s) for o in rivals):
            out = [o for o in out if o not in rivals] + [s]
    return sorted(out, key=lambda s: s[2])


def address_strings(reply: str) -> list[str]:
    lo, hi = reply.find("["), reply.rfind("]")
    try:
        got = json.loads(reply[lo : hi + 1]) if 0 <= lo < hi else []
    except ValueError:
        return []
    return got if all(isinstance(x, str) for x in got) else []


def address_spans(text: str, address: str) -> list[Span]:
    """The first place of each part between commas, and a street with the postal lines after it."""
    if len(address.strip().encode()) < 3:
        return []
    parts = [p for p in (x.strip() for x in address.split(",")) if len(p.encode()) > 2]
    out = [("address", p, at, at + len(p)) for p in parts if p.lower() not in COUNTRIES and (at := text.find(p)) >= 0]
    for p in parts:
        at = text.find(p)
        if at < 0 or not any(x in p for x in STREETS):
            continue
        end = at + len(p)
        for line in text[at:].split("\n")[1:3]:
            line = line.strip()
            if re.match(r"[0-9]{4}", line) and len(line.encode()) > 4 and (k := text.find(line, end)) >= 0:
                end = k + len(line)
        if end > at + len(p):
            return [*out, ("address", text[at:end], at, end)]
    return out


def _prompts(fields: DataFrame) -> DataFrame:
    """_n, _field and the two prompts about each text; empty texts are not asked about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            made = [pa.array([f(prepare(t, n)) if t else None for t in texts], pa.string()) for f, n in ((address_prompt, ADDRESS_WORDS), (name_prompt, NAME_WORDS))]
            yield pa.RecordBatch.from_arrays([b.column("_n"), b.column("_field"), *made], ["_n", "_field", "_address", "_name"])

    return fields.select("_n", "_field", "_text").mapInArrow(run, "_n long, _field int, _address string, _name string")


_SPAN = pa.struct([("pii_type", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def read_replies(text: str | None, places: str | None, people: str | None, fault: str | None) -> tuple[list[Span], str | None]:
    """The spans that two replies name in a text, and what is wrong with them."""
    if not text or fault:
        return [], fault
    try:
        return [s for a in address_strings(places or "") for s in address_spans(text, a)] + positions(text, parse_reply(people or "")), None
    except ValueError as e:
        return [], str(e)


def _read(rows: DataFrame) -> DataFrame:
    """rows with _found (for each of _texts the spans that its replies name) and _errors, from _texts and _told (field, places, people, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, errors = [], []
            for texts, told in zip(b.column("_texts").to_pylist(), b.column("_told").to_pylist(), strict=True):
                said = {x["field"]: x for x in told or ()}
                got = [read_replies(t, x.get("places"), x.get("people"), x.get("fault")) for t, x in ((t, said.get(k, {})) for k, t in enumerate(texts))]
                found.append([[dict(zip(("pii_type", "text", "start", "end"), s, strict=True)) for s in spans_] for spans_, _ in got])
                errors.append([e for _, e in got])
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in ("_told", "_texts")]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(found, pa.list_(pa.list_(_SPAN))), pa.array(errors, pa.list_(pa.string()))], [*[n for n, _ in kept], "_found", "_errors"])

    kept = [f for f in rows.schema.fields if f.name not in ("_told", "_texts")]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_found", T.ArrayType(pii.SPANS)), T.StructField("_errors", T.ArrayType(T.StringType()))]))


def _detected(df: DataFrame, ask: model.Ask, columns: tuple[str, ...], replies: str | None, patterns: bool, limits: dict) -> DataFrame:
    """_n, _row (all of df's columns), _e0, _e1, ... (spans of each of the columns) and _errors, stored. Texts are stored as they come and shuffled once, to their replies."""
    rows = stored(df.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_n")), "messages")
    texts = F.array(*[F.col("_row")[c] for c in columns])
    fields = rows.select("_n", F.posexplode(texts).alias("_field", "_text")).filter("_text != ''")
    prompts = stored(_prompts(fields), "prompts")
    first = model.answered(prompts, ask, replies, "_address", **limits).select("_n", "_field", "_name", F.col("reply").alias("places"), F.col("error").alias("_e"))
    both = model.answered(first, ask, replies, "_name", **limits)
    told = both.groupBy("_n").agg(F.collect_list(F.struct(F.col("_field").alias("field"), "places", F.col("reply").alias("people"), F.coalesce("_e", "error").alias("fault"))).alias("_told"))
    read = _read(rows.join(told, "_n", "left").withColumn("_texts", texts))
    text = lambda c: F.coalesce(F.col("_row")[c], F.lit(""))
    every = lambda k, c: F.concat(pii.pattern_spans(text(c)), F.col("_found")[k]) if patterns else F.col("_found")[k]
    settled = {f"_e{k}": F.when(F.col("_errors")[k].isNull(), spans.bound(every(k, c), pii.resolved)).otherwise(spans.none()) for k, c in enumerate(columns)}
    return stored(read.select("_n", "_row", "_errors", *[v.alias(n) for n, v in settled.items()]), "detected")


def detect_all(df: DataFrame, ask: model.Ask, column: str = "text", replies: str | None = None, patterns: bool = True, **limits) -> DataFrame:
    """df with entities (addresses and names by the model, and what patterns find, overlaps resolved) and error. replies: where answers are kept; patterns: False for what the model finds alone."""
    return _detected(df, ask, (column,), replies, patterns, limits).select("_row.*", F.col("_e0").alias("entities"), F.col("_errors")[0].alias("error"))


def anonymised(df: DataFrame, ask: model.Ask, columns: tuple[str, ...] = ("subject", "snippet", "body"), dictionary: str | None = None, replies: str | None = None, patterns: bool = True, order: tuple[str, ...] = (), **limits) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows of df with stand-ins in each of the columns and `replacements`; errors: row, column, error.

    Originals are numbered by the columns of `order`, then as the rows are read, then by field. Rows have a number of their
    own, so that repeated and null keys change nothing. A row of which any field could not be read is kept out and named
    under errors with its whole `row`. One dictionary serves all fields, so an original has the same stand-in wherever
    it stands; `dictionary` names the table that carries it on to later runs.
    """
    found = _detected(df, ask, columns, replies, patterns, limits)
    named = {c: f"_e{k}" for k, c in enumerate(columns)}
    failed = F.exists("_errors", lambda e: e.isNotNull())
    ready = found.filter(~failed).select("_n", "_row.*", *named.values())
    seen = standins.of_fields(ready, named, order)
    place = [*(f"_o{k}" for k in range(len(order))), "_n", "_field", "_start"]
    table = standins.fresh(seen, place) if dictionary is None else standins.extended(seen, place, dictionary)
    done = standins.replaced(ready, named, table).select(*df.columns, "replacements")
    errors = found.filter(failed).select("_row", F.posexplode("_errors").alias("_k", "error")).filter("error IS NOT NULL")
    return done, errors.select(F.col("_row").alias("row"), F.element_at(F.array(*map(F.lit, columns)), F.col("_k") + 1).alias("column"), "error")


def summary(df: DataFrame, done: DataFrame) -> DataFrame:
    """total, processed, errors (rows), replaced of an anonymised set."""
    one = lambda frame, *values: frame.select(*[v.cast("long").alias(c) for c, v in zip(("total", "processed", "replaced"), values, strict=True)])
    both = one(df, F.lit(1), F.lit(0), F.lit(0)).unionByName(one(done, F.lit(0), F.lit(1), F.size("replacements")))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns]).withColumn("errors", F.col("total") - F.col("processed"))
