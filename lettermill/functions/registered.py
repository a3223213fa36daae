"""The text functions, rules and stand-ins for SQL: temporary functions whose bodies are SQL, so they run in the JVM like any other expression.

The rule functions are written out from the rule tables. `spans_of` is a table function for LATERAL: the matches of a
pattern with their positions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fake
from . import text as X


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _picked(words: list[str], by: int) -> str:
    return f"element_at(array({', '.join(map(_quoted, words))}), CAST(seed * {by} % {len(words)} + 1 AS INT))"


def _case(rules: tuple, what: str, default: str) -> str:
    """A rule table as CASE over c, d, raw and sub."""
    from ..operators.rules import sql

    return sql(rules, what, default)


def statements() -> dict[str, str]:
    """Name and signature of each function, and its body."""
    from ..operators import route, rules

    noise = ", ".join(map(_quoted, X.NOISE))
    urgent = "|".join(route.URGENT)
    made = f"concat({_picked(fake.USERS, 11)}, CAST(seed % 999 + 1 AS STRING), '@', {_picked(fake.DOMAINS, 7)})"
    spelt = lambda a, d: f"replace(replace({made}, '@', {_quoted(a)}), '.', {_quoted(d)})"
    email = f"CASE WHEN original LIKE '<%>' THEN concat('<', {made}, '>') WHEN original LIKE '\"%\"' THEN concat('\"', {made}, '\"') WHEN contains(original, '[at]') THEN {spelt(' [at] ', ' [dot] ')} WHEN contains(original, '(at)') THEN {spelt(' (at) ', ' (dot) ')} ELSE {made} END"
    phone = f"concat('(', {_picked(fake.AREAS, 11)}, ') ', CAST(1000 + seed % 900 AS STRING), '-', CAST(1000 + seed * 17 % 9000 AS STRING))"
    place = f"CASE WHEN original RLIKE '^[0-9]' THEN concat({_picked(fake.POSTAL, 7)}, ' ', {_picked(fake.CITIES, 11)}) WHEN original RLIKE 'mann|gasse|str' THEN concat(CAST(100 + seed % 900 AS STRING), ' ', {_picked(fake.STREETS, 13)}) ELSE {_picked(fake.PLACES, 17)} END"
    name = f"concat({_picked(fake.FIRST, 7)}, ' ', {_picked(fake.LAST, 13)})"
    pieces = "zip_with(regexp_extract_all(body, pattern, 0), slice(split(body, pattern, -1), 1, size(regexp_extract_all(body, pattern, 0))), (h, g) -> named_struct('found', h, 'gap', length(g)))"
    placed = f"aggregate({pieces}, named_struct('out', CAST(array() AS ARRAY<STRUCT<found: STRING, start: BIGINT, stop: BIGINT>>), 'at', 0L), (acc, x) -> named_struct('out', concat(acc.out, array(named_struct('found', x.found, 'start', acc.at + x.gap, 'stop', acc.at + x.gap + length(x.found)))), 'at', acc.at + x.gap + length(x.found)), acc -> acc.out)"
    return {
        "spans_of(body STRING, pattern STRING) RETURNS TABLE (found STRING, start BIGINT, stop BIGINT)": f"SELECT inline({placed})",
        "meaningful_words(body STRING, n INT) RETURNS STRING": f"array_join(slice(filter(split(body, '(?U)\\\\s+'), w -> w != '' AND ((startswith(w, '[') AND endswith(w, ']')) OR NOT (lower(w) IN ({noise}) OR octet_length(lower(w)) < 2 OR NOT w RLIKE '\\\\p{{IsAlphabetic}}'))), 1, n), ' ')",
        "rule_domain(sender STRING) RETURNS STRING": "lower(coalesce(get(split(sender, '@'), 1), ''))",
        "rule_category(c STRING, d STRING, raw STRING, sub STRING) RETURNS STRING": _case(rules.DETERMINISTIC, "category", f"'{rules.DEFAULT[0]}'"),
        "rule_score(c STRING, d STRING, raw STRING, sub STRING) RETURNS DOUBLE": _case(rules.DETERMINISTIC, "score", str(rules.DEFAULT[1])),
        "is_urgent(subject STRING, snippet STRING, body STRING) RETURNS BOOLEAN": f"lower(concat_ws(' ', coalesce(subject, '(No Subject)'), coalesce(snippet, '(No Preview)'), coalesce(body, '(No Body)'))) RLIKE {_quoted(urgent)}",
        "stand_in(kind STRING, original STRING, seed BIGINT) RETURNS STRING": f"CASE lower(kind) WHEN 'name' THEN {name} WHEN 'email' THEN {email} WHEN 'phone' THEN {phone} WHEN 'location' THEN {place} WHEN 'company' THEN {_picked(fake.COMPANIES, 31)} ELSE concat('[REDACTED_', upper(kind), ']') END",
    }


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; a second call changes nothing."""
    for signature, body in statements().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
