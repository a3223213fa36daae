"""Classifiers: rules, hybrid, replay, fixed, random, model. Each adds category, score, response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import mail
from ..sources.mail import SIGNATURE
from ..sources.store import stored
from . import model
from . import rules as R

CATEGORIES = ("ActionRequired", "InterestingInfo", "Reference", "Noise", "Spam")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once a row: an exploded array of one keeps the optimiser from putting them into every use."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])


def features(messages: DataFrame, n: int = 100, html: bool = False) -> DataFrame:
    """messages with what the rules read, in lower case, as one struct `_f`: prepared text c, sender's domain d, raw (subject and snippet), sub."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    made = F.struct(F.lower(X.prepared(n, html)).alias("c"), X.rule_domain(F.col("from")).alias("d"), F.concat(low("subject"), F.lit("\n"), low("snippet")).alias("raw"), low("subject").alias("sub"))
    return once(messages, _f=made)


def by_rules(messages: DataFrame, html: bool = False) -> DataFrame:
    got = once(features(messages, html=html), _r=R.decide(R.DETERMINISTIC))
    return got.select(*messages.columns, F.col("_r.category").alias("category"), F.col("_r.score").alias("score"), F.concat(F.lit("Deterministic classification based on cleaned content and patterns: "), F.col("_r.category")).alias("response"))


def corrected(category: Column) -> Column:
    out = category
    for before, r in reversed(R.CORRECTIONS):
        out = F.when((category == before) & R.holds(r), F.lit(r.category)).otherwise(out)
    return out


def hybrid(messages: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None, html: bool = False) -> DataFrame:
    """Sure rules first; only the rest goes to `judge`, as by_model with its model (adds category, score, response, error), is corrected, and falls back to rules."""
    f = features(messages, html=html)
    sure = R.decide(R.HIGH_CONFIDENCE, (None, None))
    fall = R.decide(R.FALLBACK, reason="Default to Reference")
    columns = messages.columns
    f = once(f, _s=sure, _w=fall)
    out = lambda df, pick, prefix: df.select(*columns, pick["category"].alias("category"), pick["score"].alias("score"), F.concat(F.lit(prefix), pick["reason"]).alias("response"))
    ruled = out(f.filter(F.col("_s.category").isNotNull()), F.col("_s"), "High-confidence rule: ")
    rest = f.filter(F.col("_s.category").isNull())
    if judge is None:
        return ruled.unionByName(out(rest, F.col("_w"), "Fallback rule: "))
    asked = judge(rest.drop("_s"))
    ok = F.col("error").isNull()
    return ruled.unionByName(asked.select(*columns, F.when(ok, corrected(F.col("category"))).otherwise(F.col("_w.category")).alias("category"), F.when(ok, F.col("score")).otherwise(F.col("_w.score")).alias("score"), F.when(ok, F.col("response")).otherwise(F.concat(F.lit("Fallback rule: "), F.col("_w.reason"))).alias("response")))


def parse_reply(reply: Column) -> Column:
    """The object between the first and the last brace; category null unless all of category, score, explanation are there and valid."""
    got = F.from_json(F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), reply), "category string, score double, explanation string")
    ok = got["category"].isin(*CATEGORIES) & got["score"].between(0, 1) & got["explanation"].isNotNull()
    return F.when(ok, F.struct(got["category"].alias("category"), got["score"].alias("score"), F.format_string("LLM Response: %s (Score: %.2f)", got["explanation"], got["score"]).alias("response")))


def replay(messages: DataFrame, recordings: DataFrame) -> DataFrame:
    """Answers recorded for the same id, subject, snippet and sender; the last one recorded wins (see mail.keep_last); none is an error."""
    last = mail.keep_last(recordings).select(*[F.col(c).alias(f"_{c}") for c in SIGNATURE], F.struct("category", "score", "response").alias("_a"))
    on = [F.coalesce(messages[c], F.lit("")) == F.col(f"_{c}") for c in SIGNATURE]
    got = messages.join(last, on, "left")
    return got.select(*[messages[c] for c in messages.columns], "_a.category", "_a.score", "_a.response", F.when(F.col("_a").isNull(), F.lit("No recorded response found")).alias("error"))


def fixed(messages: DataFrame, category: str, score: float | None, error: str | None = None) -> DataFrame:
    return messages.withColumns({"category": F.lit(category if not error else None).cast("string"), "score": F.lit(score if not error else None).cast("double"), "error": F.lit(error).cast("string")})


def random(messages: DataFrame, seed: int = 0) -> DataFrame:
    """A category and a score of 0.5 to 1 drawn from a hash of the id: the same on every run and partitioning."""
    u = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(str(seed)), F.lit(str(k)))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return messages.withColumns({"category": F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.floor(u(1) * 5) + 1).cast("int")), "score": 0.5 + u(2) / 2})


def result_text(category: Column, score: Column) -> Column:
    """How a classification is shown."""
    return F.when(score.isNull(), F.concat(F.lit("Category: "), category)).otherwise(F.format_string("Category: %s (score: %.2f)", category, score))


def result(category: str, score: float | None = None) -> Column:
    """category, score, response of a single classification."""
    c, s = F.lit(category), F.lit(score).cast("double")
    return F.struct(c.alias("category"), s.alias("score"), result_text(c, s).alias("response"))


def prompt(n: int = 200, html: bool = False) -> Column:
    """What a model is asked about a message: its prepared words and the domains of its addresses."""
    return F.concat(F.lit(f"Sort this message into one of {', '.join(CATEGORIES)}. Answer with a JSON object of category, score (0 to 1) and explanation.\n"), F.coalesce(X.metadata(F.col("from"), F.col("to")), F.lit("")), F.lit("\n"), X.prepared(n, html))


def by_model(messages: DataFrame, ask: model.Ask, html: bool = False, replies: str | None = None, **limits) -> DataFrame:
    """category, score, response and error by a model (see `model`): equal prompts are asked once, a failed one is its rows' error. replies: where answers are kept."""
    rows = stored(messages.select(F.struct("*").alias("_m"), prompt(html=html).alias("_prompt")), "asked")
    got = model.answered(rows, ask, replies, "_prompt", **limits)
    answer = parse_reply(F.col("reply"))
    error = F.when(F.col("reply").isNull(), F.coalesce("error", F.lit("no reply"))).when(answer.isNull(), F.lit("no valid answer in the reply"))
    return got.select("_m.*", answer["category"].alias("category"), answer["score"].alias("score"), answer["response"].alias("response"), error.alias("error"))
