"""Text cleaning and HTML to text as column expressions; read_html is the same for the prompts of a model, which are made in Python."""

from __future__ import annotations

import re
from html.entities import name2codepoint
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that results depend on.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"https?://[^\s]+|www\.[^\s]+"
UTM = r"utm_[^&\s]*"
TRACKING = UTM + r"|[?&][^=]*=[^&\s]*"
ENTITY = r"&[a-zA-Z0-9#]+;"
SPECIAL = r"[^\w\s.,!?;:()\-'\[\]]"
INVISIBLE = "​‌‍⁠﻿­‎"
NOISE = "unsubscribe click here view browser privacy policy terms conditions copyright reserved rights inc ltd llc corp company follow twitter facebook instagram linkedin subscribe newsletter update preferences".split()


def _untracked(text: Column) -> Column:
    """TRACKING taken out. Behind the last = (and what follows it without a blank or &) only UTM can match, so no ? or & is followed to the text's end in vain."""
    without = lambda t, pattern: F.regexp_replace(t, "(?U)" + pattern, "")

    def split(t: Column, last: Column) -> Column:
        return F.transform(F.array(last + F.length(F.regexp_extract(F.substr(t, last + 1), r"(?U)^[^&\s]*", 0))), lambda n: F.concat(without(F.substr(t, F.lit(1), n), TRACKING), without(F.substr(t, n + 1), UTM)))[0]

    def one(t: Column) -> Column:
        return F.when(~F.contains(t, F.lit("=")), without(t, UTM)).otherwise(F.transform(F.array(F.length(t) + 1 - F.instr(F.reverse(t), "=")), lambda last: split(t, last))[0])

    # lambdas bind what is used more than once
    return F.transform(F.array(text), one)[0]


def clean(text: Column) -> Column:
    """Entities, addresses, links, tracking, control and special characters taken out, blanks collapsed."""
    for pattern, by in ((ENTITY, " "), (EMAIL, "[EMAIL]"), (URL, "[URL]")):
        text = F.regexp_replace(text, "(?U)" + pattern, by)
    text = _untracked(text)
    for pattern, by in ((r"[\p{Cntrl}&&[^\s]]", ""), (SPECIAL, " "), (r"\s+", " ")):
        text = F.regexp_replace(text, "(?U)" + pattern, by)
    return F.trim(F.translate(text, INVISIBLE, ""))


def is_noise(word: Column) -> Column:
    low = F.lower(word)
    marked = word.startswith("[") & word.endswith("]")
    return ~marked & (low.isin(*NOISE) | (F.octet_length(low) < 2) | ~word.rlike(r"\p{IsAlphabetic}"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def meaningful(text: Column, n: int) -> Column:
    """The first n words that are no noise."""
    return F.array_join(F.slice(F.filter(words(text), lambda w: ~is_noise(w)), 1, n), " ")


def first_words(text: Column, n: int) -> Column:
    w = words(text)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(text)


def prepared(n: int, html: bool = False) -> Column:
    """Subject twice as it is, then snippet and body cleaned; the first n words that tell something."""
    subject = F.when(F.col("subject") != "", F.concat(F.col("subject"), F.lit(" "), F.col("subject"), F.lit(" ")))
    snippet = F.when(F.col("snippet") != "", F.concat(clean(F.col("snippet")), F.lit(" ")))
    body = F.col("body")
    plain = clean(body)
    body = F.when(body != "", F.when(body.contains("<") & body.contains(">"), clean(html_text(body))).otherwise(plain) if html else plain)
    none = F.lit("")
    return meaningful(F.concat(F.coalesce(subject, none), F.coalesce(snippet, none), F.coalesce(body, none)), n)


def rule_domain(sender: Column) -> Column:
    """What stands between the first and second @, in lower case."""
    return F.lower(F.coalesce(F.get(F.split(sender, "@"), 1), F.lit("")))


def domain(address: Column) -> Column:
    """What follows the last @, without brackets and quotes; null unless it has a dot."""
    d = F.lower(F.btrim(F.substring_index(address, "@", -1), F.lit('<>" ')))
    return F.when(address.contains("@") & (d != "") & d.contains("."), d)


def metadata(sender: Column, to: Column) -> Column:
    names = F.transform(F.filter(F.transform(F.coalesce(to, F.array().cast("array<string>")), domain), lambda d: d.isNotNull()), lambda d: F.concat(F.lit("to_domain:"), d))
    return F.concat_ws(" ", F.concat(F.lit("from_domain:"), domain(sender)), F.when(F.size(names) > 0, F.array_join(names, " ")))


def strip_html(html: Column) -> Column:
    for tag in ("<br>", "<br/>", "<br />", "</p>", "</div>"):
        html = F.replace(html, F.lit(tag), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"(?U)^\s+|\s+$", "")


class _Reader(HTMLParser):
    """Text, then the links it had."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("br", "p", "div", "li", "tr", "h1", "h2", "h3"):
            self.out.append("\n")
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "tr"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def read_html(html: str | None) -> str | None:
    if html is None:
        return None
    r = _Reader()
    r.feed(html)
    r.close()
    text = re.sub(r"[^\S\n]+", " ", "".join(r.out))
    return "\n".join([text.strip(), *[f"[{k}]: {v}" for k, v in enumerate(r.links, 1)]])


# --- HTML to text ---
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
_BLOCKS = "br|p|div|li|tr|h1|h2|h3"


def _entities(text: Column) -> Column:
    """Numbers and the names of HTML 4 that end in a semicolon, as their characters; other names stay."""
    names = F.create_map(*[F.lit(x) for k, v in name2codepoint.items() for x in (k, chr(v))])
    number = lambda e: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(e, "^&#([0-9]+);$", 1), F.lit("")), F.lit("9999999")).cast("long"), F.conv(F.nullif(F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+);$", 1), F.lit("")), 16, 10).cast("long"))
    # code points are spelt in UTF-8, as there is no function that makes a character above 255
    code = lambda n: F.decode(F.unhex(F.format_string("%08x", n)), "utf-32")
    fits = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    one = lambda e: F.coalesce(F.get(F.array(F.try_element_at(names, F.btrim(e, F.lit("&;")))), 0), F.transform(F.array(number(e)), lambda n: F.when(fits(n), code(n)))[0], e)
    pieces = F.transform(F.array(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))), lambda hits: F.concat(F.flatten(F.zip_with(F.slice(F.split(text, _ENTITY, -1), F.lit(1), F.size(hits)), hits, lambda gap, e: F.array(gap, one(e)))), F.slice(F.split(text, _ENTITY, -1), -1, 1)))[0]
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of HTML, then its links by number: blocks begin a line, blanks run together, scripts, styles and comments are left out. Lines are as long as they are: whoever reads words sees no difference."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>", "")
    links = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1)), lambda x: _entities(F.regexp_replace(x, r"""^["']|["']$""", ""))), lambda x: x != "")
    t = F.regexp_replace(t, rf"(?i)<(?:{_BLOCKS})\b[^>]*>|</(?:p|div|li|tr)\s*>", "\n")
    t = F.btrim(F.regexp_replace(_entities(F.regexp_replace(t, r"</?[a-zA-Z][^>]*>", "")), r"(?U)[\s&&[^\n]]+", " "), F.lit(" \n"))
    shown = F.transform(links, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]: "), x))
    return F.when(html.isNotNull(), F.concat_ws("\n", t, F.when(F.size(shown) > 0, F.array_join(shown, "\n"))))


def truncated(subject: Column, n: int = 50) -> Column:
    """Texts of more than n bytes are cut after n - 3 bytes; a character that would be cut in two goes too."""
    raw = F.encode(subject, "utf-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, n - 3).cast("string"))
    return F.when(F.octet_length(subject) > n, F.concat(F.regexp_replace(cut, "\ufffd+$", ""), F.lit("..."))).otherwise(subject)


def chars_within(text: Column, most: Column) -> Column:
    """How many whole characters the first `most` bytes hold: the place before a character that would be cut."""
    cut = F.substring(F.encode(text, "utf-8"), F.lit(1), most.cast("int"))
    # bytes that begin a character, but for the last one if it isn't whole
    begun = F.length(F.translate(F.decode(cut, "iso-8859-1"), "".join(map(chr, range(0x80, 0xC0))), ""))
    return F.when(F.is_valid_utf8(cut.cast("string")), begun).otherwise(begun - 1).cast("long")
