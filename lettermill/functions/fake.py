"""Invented stand-ins for personal data, a function of a seed alone: columns, so SQL can check them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words stand-ins are made of.
FIRST = "Alex Jordan Taylor Casey Morgan Riley Avery Cameron".split()
LAST = "Smith Johnson Williams Brown Jones Garcia Miller Davis".split()
DOMAINS = ["example.com", "test.org", "sample.net", "demo.co.uk", "fake.ch"]
USERS = ["user", "contact", "admin", "info", "support", "team"]
AREAS = ["555", "123", "456", "789"]
STREETS = ["Main Street", "Oak Avenue", "First Street", "Park Avenue", "Elm Street"]
CITIES = ["Springfield", "Riverside", "Franklin", "Georgetown", "Clinton"]
PLACES = [*CITIES, "Centerville"]
STATES = ["CA", "NY", "TX", "FL", "WA"]
POSTAL = ["1000", "2000", "3000", "4000", "5000"]
COMPANIES = ["TechCorp", "DataSystems", "InfoTech", "GlobalSoft", "NextGen Solutions"]


def _pick(words: list[str], seed: Column, by: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (seed * by % len(words) + 1).cast("int"))


def _text(n: Column) -> Column:
    return n.cast("long").cast("string")


def name(seed: Column) -> Column:
    return F.concat_ws(" ", _pick(FIRST, seed, 7), _pick(LAST, seed, 13))


def email(original: Column, seed: Column) -> Column:
    made = F.concat(_pick(USERS, seed, 11), _text(seed % 999 + 1), F.lit("@"), _pick(DOMAINS, seed, 7))
    spelt = lambda a, d: F.replace(F.replace(made, F.lit("@"), F.lit(a)), F.lit("."), F.lit(d))
    return F.when(original.startswith("<") & original.endswith(">"), F.concat(F.lit("<"), made, F.lit(">"))).when(original.startswith('"') & original.endswith('"'), F.concat(F.lit('"'), made, F.lit('"'))).when(original.contains("[at]"), spelt(" [at] ", " [dot] ")).when(original.contains("(at)"), spelt(" (at) ", " (dot) ")).otherwise(made)


def phone(seed: Column) -> Column:
    return F.concat(F.lit("("), _pick(AREAS, seed, 11), F.lit(") "), _text(1000 + seed % 900), F.lit("-"), _text(1000 + seed * 17 % 9000))


def address(seed: Column) -> Column:
    return F.concat(_text(100 + seed % 900), F.lit(" "), _pick(STREETS, seed, 19), F.lit(", "), _pick(CITIES, seed, 23), F.lit(", "), _pick(STATES, seed, 29), F.lit(" "), _text(10000 + seed % 90000))


def location(original: Column, seed: Column) -> Column:
    street = original.contains("mann") | original.contains("gasse") | original.contains("strasse") | original.contains("str")
    return F.when(original.rlike("^[0-9]"), F.concat_ws(" ", _pick(POSTAL, seed, 7), _pick(CITIES, seed, 11))).when(street, F.concat_ws(" ", _text(100 + seed % 900), _pick(STREETS, seed, 13))).otherwise(_pick(PLACES, seed, 17))


def company(seed: Column) -> Column:
    return _pick(COMPANIES, seed, 31)


def stand_in(kind: Column, original: Column, seed: Column) -> Column:
    low = F.lower(kind)
    return F.when(low == "name", name(seed)).when(low == "email", email(original, seed)).when(low == "phone", phone(seed)).when(low == "address", address(seed)).when(low == "location", location(original, seed)).when(low == "company", company(seed)).otherwise(F.concat(F.lit("[REDACTED_"), F.upper(kind), F.lit("]")))
