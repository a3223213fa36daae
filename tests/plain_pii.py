"""Personal data by patterns, as plain Python: what the tests hold the columns against."""

import re

from lettermill.operators.pii import CITIES, EMAIL, LOCATION, PHONE, STREETS

_COMPILED = [("phone", [re.compile(p) for p in PHONE]), ("email", [re.compile(p) for p in EMAIL]), ("location", [re.compile(p) for p in LOCATION])]
_CITY = re.compile(rf"\b(?:{'|'.join(map(re.escape, CITIES))})\b")

Span = tuple[str, str, int, int]


def phone_ok(text: str) -> bool:
    number = text.split("ext")[0].strip()
    digits = re.sub(r"[^0-9]", "", number)
    if number.startswith("+"):
        return 7 <= len(digits) <= 15
    if len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    return len(digits) == 10 and digits[0] not in "01"


def email_ok(text: str) -> bool:
    clean = text.strip('<>"')
    for a, b in (("[at]", "@"), ("(at)", "@"), ("[dot]", "."), ("(dot)", ".")):
        clean = clean.replace(a, b)
    parts = clean.split("@")
    if len(parts) != 2 or not 1 <= len(parts[0].encode()) <= 64 or not 1 <= len(parts[1].encode()) <= 253:
        return False
    labels = parts[1].split(".")
    return len(labels) > 1 and all(labels) and len(labels[-1]) >= 2


def location_ok(text: str) -> bool:
    if re.search(r"\b[1-9]\d{3}\b", text):
        return False
    parts = text.split()
    if text[0] in "0123456789" and len(parts) > 1 and re.fullmatch("[0-9]+", parts[0]) and 1000 <= int(parts[0]) <= 99999:
        return True
    return any(x in text for x in STREETS) or ("-" in text and len(text.encode()) <= 8)


def _longer(a: Span, b: Span) -> bool:
    return len(a[1].encode()) > len(b[1].encode())


def merged(found: list[Span]) -> list[Span]:
    """Each in turn: appended, or in place of the first that it overlaps if it is longer; at last by start."""
    out: list[Span] = []
    for s in found:
        k = next((k for k, o in enumerate(out) if s[2] < o[3] and o[2] < s[3]), None)
        if k is None:
            out.append(s)
        elif _longer(s, out[k]):
            out[k] = s
    return sorted(out, key=lambda s: s[2])


def pattern_spans(text: str) -> list[Span]:
    """Spans of the three pattern detectors, one after the other."""
    cities = [("location", m[0], m.start(), m.end()) for m in _CITY.finditer(text)]
    if not cities and "@" not in text and not any(c.isdigit() for c in text) and "[at]" not in text and "(at)" not in text:
        return []
    every: list[Span] = []
    for kind, patterns in _COMPILED:
        ok = {"phone": phone_ok, "email": email_ok}.get(kind, location_ok)
        found = merged([(kind, m[0], m.start(), m.end()) for p in patterns for m in p.finditer(text) if ok(m[0])])
        if kind == "location":
            found = sorted(found + [c for c in cities if all(c[3] <= o[2] or o[3] <= c[2] for o in found)], key=lambda s: s[2])
        every += found
    return every


def detect_text(text: str) -> list[Span]:
    return resolved(pattern_spans(text))


def resolved(every: list[Span]) -> list[Span]:
    """Overlaps between detectors resolved: the longer wins, and a pattern's span wins over a name."""
    out: list[Span] = []
    for s in sorted(every, key=lambda s: s[2]):
        k = next((k for k, o in enumerate(out) if s[2] < o[3] and o[2] < s[3]), None)
        if k is None:
            out.append(s)
        elif _longer(s, out[k]) or (s[0] in ("phone", "email", "location") and out[k][0] == "name"):
            out[k] = s
    return out
