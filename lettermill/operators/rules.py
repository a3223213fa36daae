"""Decision lists as data, compiled to column expressions and to SQL.

A rule is a list of alternatives, each a conjunction of terms: a substring of the prepared text `c`, with `d:`
of the sender's domain, with `raw:` of subject or snippet, with `sub:` of the subject; `!` before it negates,
and `a/b` is either.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules' words, categories and scores.
_AR, _II, _REF, _NOISE, _SPAM = "ActionRequired", "InterestingInfo", "Reference", "Noise", "Spam"


@dataclass(frozen=True)
class Rule:
    any_of: tuple[tuple[str, ...], ...]
    category: str
    score: float
    reason: str = ""


def rule(category: str, score: float, text: str, reason: str = "") -> Rule:
    """text: alternatives by |, terms by &."""
    return Rule(tuple(tuple(t.strip() for t in a.split("&")) for a in text.split("|")), category, score, reason)


DETERMINISTIC = (
    rule(_AR, 0.9, "ci&failed|meeting&tomorrow/reminder|urgent|asap|action required|deadline|due|transfer&ticket|schule|school"),
    rule(_II, 0.85, "raw:newsletter&tech/ai/news|digest&tech/ai/news|security&alert|economics|financial|scam&protect|new login|login&device|d:nytimes|d:anthropic&update"),
    rule(_REF, 0.8, "receipt|invoice|confirmation|delivered|consignment|shipping|terms&conditions|welcome&plan|login&secure|bbq|tomorrow&!meeting"),
    rule(_SPAM, 0.95, "lottery|won&million|click here&claim|suspicious&offer"),
    rule(
        _NOISE,
        0.85,
        "d:noreply|d:no-reply|d:marketing|d:mailchimp|d:sendgrid|d:constantcontact|d:mailgun|d:campaign|d:facebook|d:linkedin|d:twitter|d:instagram|d:social|d:notifications|d:aliexpress|d:nespresso|d:shopify|d:etsy"
        "|limited time|exclusive|deal|discount|offer|sale|flash sale|special offer|promotion|promotional|follow&linkedin/ceo|notification&facebook/social|posted&update|connection|add&contact|people you may know|suggested|someone liked|new followers"
        "|to pair with|you might like|recommended for you|based on your|complete your|accessories|wishlist&sale|raw:newsletter&!tech&!ai&!security|d:newsletter&!tech&!ai&!security|weekly digest&!tech&!ai|monthly update&!security&!tech"
        "|weekly&roundup/digest/sports/entertainment/celebrity/tips|monthly&roundup/digest/updates|healthy living|lifestyle&tips|wellness|health&tips/advice|marketing|subscribe|shop now|buy now|while supplies last|hurry|don't miss|act now"
        "|events near you|in your area|local events|near your location|at your location|someone was at|concert tickets|tickets available|tickets&concerts/shows/events|get tickets|upcoming concerts|raw:unsubscribe",
    ),
)
HIGH_CONFIDENCE = (
    rule(_AR, 0.95, "ci&failed", "CI failure detected"),
    rule(_AR, 0.90, "urgent|asap", "Urgent content detected"),
    rule(_AR, 0.92, "transfer&ticket", "Ticket transfer required"),
    rule(_AR, 0.88, "schule|school", "School communication"),
    rule(_AR, 0.89, "rental&car/vehicle|booking&driver/coverage|cross-border|rent&audi/enterprise", "Car rental/travel booking communication"),
    rule(_REF, 0.92, "receipt|invoice", "Receipt/invoice detected"),
    rule(_REF, 0.90, "delivered|consignment", "Delivery confirmation"),
    rule(_REF, 0.85, "welcome&plan", "Service welcome message"),
    rule(_NOISE, 0.92, "d:noreply|d:no-reply|d:marketing|d:mailchimp|d:sendgrid|d:constantcontact", "Marketing/promotional domain"),
    rule(_NOISE, 0.93, "d:just-eat|d:justeat|d:ubereats|d:foodora|d:deliveroo|d:grubhub|d:doordash", "Food delivery promotional email"),
    rule(_NOISE, 0.88, "d:facebook|d:linkedin|d:twitter|d:instagram", "Social media platform"),
    rule(_NOISE, 0.90, "limited time&offer|exclusive&deal|flash sale|special offer|nicht verpassen&rabatt|angebot&sparen|exklusiv|rabatt&chf", "Promotional language detected (German/English)"),
    rule(_NOISE, 0.88, "to pair with|you might like|recommended for you", "Product recommendation"),
    rule(_NOISE, 0.85, "follow&ceo", "Social connection suggestion"),
    rule(_NOISE, 0.87, "notification&d:facebook", "Facebook notification"),
    rule(_NOISE, 0.82, "newsletter&!tech&!security&!ai", "Generic newsletter content"),
    rule(_II, 0.85, "security&alert", "Security alert"),
    rule(_II, 0.83, "economics|financial", "Economic/financial content"),
)
FALLBACK = (
    rule(_II, 0.70, "newsletter&tech", "Tech newsletter content"),
    rule(_REF, 0.75, "terms&conditions", "Terms and conditions update"),
    rule(_NOISE, 0.70, "unsubscribe|d:marketing|offer|deal|sale|discount|promotion|subscribe|newsletter&!tech&!ai&!security|weekly&!security|monthly&!security|digest&!tech|d:shopify|d:etsy|near you|in your area|people you may know|suggested|follow|connection", "Marketing/promotional content"),
)
#: (category before, rule): the category changes, the score stays.
CORRECTIONS = ((_AR, rule(_REF, 0, "login&secure", "Login link")), (_AR, rule(_REF, 0, "sub:tomorrow&!meeting&!deadline", "Personal conversation")), (_AR, rule(_NOISE, 0, "purchased|pair with", "Product recommendation")), (_SPAM, rule(_REF, 0, "login&claude/anthropic", "Legitimate login link")), (_SPAM, rule(_NOISE, 0, "newsletter|unsubscribe", "Newsletter")))
DEFAULT = (_REF, 0.6)
SHORT = {"raw": "raw", "d": "d", "sub": "sub"}


def _terms(term: str) -> tuple[bool, str, list[str]]:
    negated = term.startswith("!")
    head, _, rest = term.lstrip("!").partition(":")
    return (negated, head, rest.split("/")) if rest and head in SHORT else (negated, "c", term.lstrip("!").split("/"))


def holds(r: Rule) -> Column:
    """Over the struct _f of classify.features."""

    def one(term: str) -> Column:
        negated, column, options = _terms(term)
        got = reduce(lambda a, b: a | b, [F.col(f"_f.{column}").contains(o) for o in options])
        return ~got if negated else got

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(one, alternative)) for alternative in r.any_of])


def decide(rules: tuple[Rule, ...], default: tuple[str | None, float | None] = DEFAULT, reason: str = "") -> Column:
    """The first rule that holds, as a struct of category and score."""
    made = lambda c, s, why: F.struct(F.lit(c).cast("string").alias("category"), F.lit(s).cast("double").alias("score"), F.lit(why).cast("string").alias("reason"))
    out = made(*default, reason)
    for r in reversed(rules):
        out = F.when(holds(r), made(r.category, r.score, r.reason)).otherwise(out)
    return out


def sql(rules: tuple[Rule, ...], what: str, default: str) -> str:
    """The same list as a SQL CASE; what: category or score."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def one(term: str) -> str:
        negated, column, options = _terms(term)
        got = "(" + " OR ".join(f"contains({column}, {quote(o)})" for o in options) + ")"
        return f"NOT {got}" if negated else got

    shown = lambda r: quote(r.category) if what == "category" else f"CAST({r.score} AS DOUBLE)"
    return "CASE " + " ".join("WHEN " + " OR ".join("(" + " AND ".join(map(one, a)) + ")" for a in r.any_of) + f" THEN {shown(r)}" for r in rules) + f" ELSE {default} END"
