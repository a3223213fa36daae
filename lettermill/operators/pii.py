"""Personal data: detection with positions, resolution of overlaps, consistent replacement, audit, spot check."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import stored
from . import spans, standins

# Patterns in order of priority.
PHONE = [r"\d{3}-\d{3}-\d{4}\s+ext\s+\d{1,4}", r"\+\d{1,4}\s\d{1,4}\s\d{1,4}\s\d{1,4}", r"\+\d{8,15}", r"\+1-\d{3}-\d{3}-\d{4}", r"\(\d{3}\)\s?\d{3}-\d{4}", r"\d{3}-\d{3}-\d{4}", r"\d{3}\.\d{3}\.\d{4}", r"\b\d{10}\b"]
_ADDRESS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL = [rf"\b{_ADDRESS}\b", rf"<{_ADDRESS}>", rf'"{_ADDRESS}"', _ADDRESS, r"\b[a-zA-Z0-9._%-]+\s*\[at\]\s*[a-zA-Z0-9.-]+\s*\[dot\]\s*[a-zA-Z]{2,}\b", r"\b[a-zA-Z0-9._%-]+\s*\(at\)\s*[a-zA-Z0-9.-]+\s*\(dot\)\s*[a-zA-Z]{2,}\b"]
LOCATION = [r"\b\d{4}\s+[A-ZÄÖÜa-zäöüß]+(?:\s+[A-ZÄÖÜa-zäöüß]+)*\b", r"\b[A-ZÄÖÜa-zäöüß]+(?:mann|berg|hof|weg|gasse|strasse|str\.)\s+\d+[a-z]?\b", r"\b[A-Z]-\d{4,5}\b", r"\b\d{5}\s+[A-ZÄÖÜa-zäöüß]+\b"]
STREETS = ("mann", "berg", "hof", "weg", "gasse", "strasse", "str.")
CITIES = ["Zürich", "Zurich", "Geneva", "Genève", "Basel", "Bern", "Lausanne", "Winterthur", "Luzern", "Lucerne", "St. Gallen", "Sankt Gallen", "Lugano", "Biel", "Bienne", "Thun", "Köniz", "La Chaux-de-Fonds", "Schaffhausen", "Fribourg", "Chur", "Vernier", "Neuchâtel", "Uster", "Sion", "Lancy", "Yverdon-les-Bains", "Emmen", "Zug", "Kriens", "Rapperswil-Jona", "Dübendorf", "Dietikon", "Riehen", "Montreux", "Frauenfeld", "Küsnacht", "Küssnacht", "Thalwil", "Wetzikon", "Baar", "Meyrin", "Carouge", "Wädenswil", "Allschwil"]
FIRST_NAMES = "John Jane Michael Sarah David Emily Robert Jessica William Ashley Richard Amanda Joseph Stephanie Thomas Michelle".split()
REAL_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
REAL_PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
CITY = rf"\b(?:{'|'.join(f'{a}(?:{b})' for a, b in sorted({c[0]: '|'.join(re.escape(x[1:]) for x in CITIES if x[0] == c[0]) for c in CITIES}.items()))})\b"
SPANS = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
PATTERN_TYPES = ("phone", "email", "location")


def phone_ok(text: Column) -> Column:
    number = F.trim(F.split_part(text, F.lit("ext"), F.lit(1)))
    digits = F.regexp_replace(number, "[^0-9]", "")
    own = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (number.startswith("+") & F.length(digits).between(7, 15)) | ((F.length(own) == 10) & ~F.substring(own, 1, 1).isin("0", "1"))


def email_ok(text: Column) -> Column:
    clean = F.btrim(text, F.lit('<>"'))
    for a, b in (("[at]", "@"), ("(at)", "@"), ("[dot]", "."), ("(dot)", ".")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    parts = F.split(clean, "@", -1)
    labels = F.split(F.coalesce(F.get(parts, 1), F.lit("")), "[.]", -1)
    return (F.size(parts) == 2) & F.octet_length(parts[0]).between(1, 64) & F.coalesce(F.octet_length(F.get(parts, 1)).between(1, 253), F.lit(False)) & (F.size(labels) > 1) & ~F.exists(labels, lambda x: x == "") & (F.length(F.element_at(labels, -1)) >= 2)


def location_ok(text: Column) -> Column:
    """No whole number of four digits; a number from 1000 to 99999 before a name, a street, or a short code with a hyphen."""
    code = F.regexp_extract(text, r"(?U)^([0-9]+)\s+\S", 1)
    street = text.rlike("|".join(map(re.escape, STREETS)))
    return ~text.rlike(r"(?U)\b[1-9]\d{3}\b") & (F.coalesce(F.try_to_number(F.nullif(code, F.lit("")), F.lit("99999")).between(1000, 99999), F.lit(False)) | street | (text.contains("-") & (F.octet_length(text) <= 8)))


def _of(text: Column, kind: str, patterns: list[str], ok) -> Column:
    every = F.concat(*[spans.places(text, p, kind) for p in patterns])
    return spans.bound(F.filter(every, lambda s: ok(s["text"])), spans.settled)


def phone_spans(text: Column) -> Column:
    """Phone numbers, overlaps settled; texts without three digits or a plus before one are passed over."""
    return F.when(text.rlike(r"(?U)\d{3}|\+\d"), _of(text, "phone", PHONE, phone_ok)).otherwise(spans.none())


def email_spans(text: Column) -> Column:
    there = text.contains("@") | text.contains("[at]") | text.contains("(at)")
    return F.when(there, _of(text, "email", EMAIL, email_ok)).otherwise(spans.none())


def location_spans(text: Column) -> Column:
    """Places by pattern, then known cities where nothing overlaps, by start."""
    numbered_ = F.when(text.rlike(r"(?U)\d"), _of(text, "location", LOCATION, location_ok)).otherwise(spans.none())
    cities = F.when(text.rlike(f"(?U){CITY}"), spans.places(text, CITY, "location")).otherwise(spans.none())
    return spans.bound(numbered_, lambda s: spans.bound(cities, lambda c: spans.by_start(spans.add_apart(s, c))))


def pattern_spans(text: Column) -> Column:
    """What the three pattern detectors find, one after the other."""
    return F.concat(phone_spans(text), email_spans(text), location_spans(text))


def resolved(every: Column) -> Column:
    """Overlaps between detectors settled, by start: the longer wins, and a pattern's span wins over a name."""
    wins = lambda new, old: spans.longer(new, old) | (new["pii_type"].isin(*PATTERN_TYPES) & (old["pii_type"] == "name"))
    return spans.settled(every, wins, in_order=False)


def detect(df: DataFrame, column: str = "text") -> DataFrame:
    """df with entities: (pii_type, text, start, end), in characters; of a null text none."""
    found = spans.bound(F.coalesce(F.col(column), F.lit("")), lambda t: spans.bound(pattern_spans(t), resolved))
    return df.withColumn("entities", found)


def byte_offset(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at)).cast("long")


def mapping(detected: DataFrame, order: str) -> DataFrame:
    """text, pii_type, seed, stand_in: of each distinct original, by where it is first seen; the first type met counts."""
    found = detected.select(F.col(order).alias("_o"), F.explode("entities").alias("e")).select("_o", F.col("e.start").alias("_s"), "e.text", "e.pii_type")
    return standins.fresh(found, ["_o", "_s"])


def replaced(detected: DataFrame, key: str, column: str = "text", dictionary: str | None = None) -> DataFrame:
    """detected with the column replaced, and `replacements`; one row for each row of detected, whatever its key, by which originals are numbered."""
    rows = stored(detected.withColumn("_n", F.monotonically_increasing_id()), "entities")
    found = standins.of_fields(rows, {column: "entities"}, (key,))
    place = ["_o0", "_n", "_start"]
    table = standins.fresh(found, place) if dictionary is None else standins.extended(found, place, dictionary)
    return standins.replaced(rows, {column: "entities"}, table).drop("_n")


def suspicious_emails(text: Column) -> Column:
    """An address that is none of the stand-ins': example.com, user with one @, userN."""
    found = F.regexp_extract_all(text, F.lit(f"(?U){REAL_EMAIL}"), F.lit(0))
    known = lambda e: e.contains("example.com") | (e.contains("user") & (F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit(""))) == 1)) | e.rlike("^user[0-9]")
    return F.exists(found, lambda e: ~known(e))


def suspicious_phones(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(REAL_PHONE), F.lit(0)), lambda p: ~p.contains("555"))


def suspicious_names(text: Column) -> Column:
    words = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^\P{L}+|\P{L}+$", "")))
    return F.exists(F.array(*map(F.lit, FIRST_NAMES)), lambda n: F.contains(text, n) & F.array_contains(words, F.lower(n)))


def text_fields(messages: DataFrame) -> DataFrame:
    """id, field, text: subject, sender, body and snippet of each message, as far as it has them."""
    fields = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(c).alias("field"), F.col(c).alias("text")) for k, c in enumerate(("subject", "from", "body", "snippet"))])
    return messages.select("id", F.explode(F.filter(fields, lambda x: x["text"].isNotNull())).alias("f")).select("id", "f.place", "f.field", "f.text")


def spot_check(messages: DataFrame, files: int = 10) -> DataFrame:
    """id, field, warning of the first messages by id: the number of messages is the feature."""
    first = messages.select("id").distinct().orderBy("id").limit(files)
    t = F.col("text")
    kinds = F.array(*[F.when(f(t), F.lit(w)) for f, w in ((suspicious_emails, "email"), (suspicious_phones, "phone"), (suspicious_names, "name"))])
    return text_fields(messages).join(F.broadcast(first), "id").select("id", "field", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("warning"))
