"""The registered queries, each with the SQL that gives the same rows on the same tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fake, registered
from ..functions import text as X
from ..operators import analysis, classify, known, names, pii, progress, route, spans
from ..operators import rules as R
from ..sources import mail, mailbox, mime, store
from . import cases

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- SQL pieces: the message view, cleaning and features, in DuckDB's dialect ---
_BLANK = r"[\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_BLANK = _BLANK.replace("[", "[^", 1)
_TRIMS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32)"
_WORDS = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_MAIL = "m AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS subject, substring(text, 1, 200) AS snippet, source || '@' || lang || '.example.com' AS sender, text AS body FROM documents)"


def _sql_clean(x: str) -> str:
    spaces = _BLANK[1:-1]
    no = spaces
    for pattern, by in ((X.ENTITY, " "), (X.EMAIL, "[EMAIL]"), (f"https?://{_NOT_BLANK}+|www\\.{_NOT_BLANK}+", "[URL]"), (f"utm_[^&{no}]*|[?&][^=]*=[^&{no}]*", ""), (r"[\x{00}-\x{08}\x{0e}-\x{1f}\x{7f}-\x{84}\x{86}-\x{9f}]", ""), (f"[^{_WORDS}{spaces}.,!?;:()\\-'\\[\\]]", " "), (f"{_BLANK}+", " ")):
        pattern = pattern.replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({x}, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{ad}}\\x{{200e}}]', '', 'g'))"


def _sql_noise(w: str) -> str:
    words = ", ".join(f"'{x}'" for x in X.NOISE)
    return f"(NOT ({w} LIKE '[%' AND {w} LIKE '%]') AND (lower({w}) IN ({words}) OR octet_length(encode(lower({w}))) < 2 OR NOT regexp_matches({w}, '[\\p{{L}}\\p{{Nl}}]')))"


def _sql_words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{_BLANK}+'), lambda w: w <> '')"


def _sql_prepared(n: int) -> str:
    whole = f"(CASE WHEN subject <> '' THEN subject || ' ' || subject || ' ' ELSE '' END || CASE WHEN snippet <> '' THEN {_sql_clean('snippet')} || ' ' ELSE '' END || {_sql_clean('body')})"
    return f"array_to_string(list_slice(list_filter({_sql_words(whole)}, lambda w: NOT {_sql_noise('w')}), 1, {n}), ' ')"


_FEATURES = f"{_MAIL}, f AS MATERIALIZED (SELECT *, lower({_sql_prepared(100)}) AS c, lower(split_part(sender, '@', 2)) AS d, lower(subject) || chr(10) || lower(snippet) AS raw, lower(subject) AS sub FROM m)"
_RULED = f"{_FEATURES}, r AS MATERIALIZED (SELECT *, {R.sql(R.DETERMINISTIC, 'category', chr(39) + 'Reference' + chr(39))} AS category, {R.sql(R.DETERMINISTIC, 'score', '0.6')} AS score FROM f)"
_URGENT = lambda words: "(" + " OR ".join(f"contains(lower(subject || ' ' || snippet || ' ' || body), '{w}')" for w in words) + ")"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = mail.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "Reference").otherwise("Noise").alias("truth"))
    return analysis.with_truth(_ruled(spark, sf_dir), truth)


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.by_rules(mail.messages(spark, sf_dir))


@_query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@_query(f"SELECT doc_id, array_to_string(list_slice(list_filter({_sql_words('text')}, lambda w: NOT {_sql_noise('w')}), 1, 50), ' ') AS words FROM documents")
def meaningful_words(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("doc_id", X.meaningful(F.col("text"), 50).alias("words"))


@_query(f"WITH {_MAIL} SELECT id, {_sql_prepared(100)} AS prepared FROM m")
def prepared_text(spark, sf_dir):
    return mail.messages(spark, sf_dir).select("id", X.prepared(100).alias("prepared"))


@_query("SELECT doc_id, lower(split_part(source || '@' || lang || '.example.com', '@', 2)) AS sender_domain FROM documents")
def sender_domain_first_at(spark, sf_dir):
    return mail.messages(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), X.rule_domain(F.col("from")).alias("sender_domain"))


@_query("SELECT doc_id, 'from_domain:' || lang || '.example.com to_domain:list.example.com' AS metadata FROM documents")
def recipient_domain_last_at(spark, sf_dir):
    return mail.messages(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), X.metadata(F.col("from"), F.col("to")).alias("metadata"))


@_query("SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(html, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '</p>', chr(10)), '</div>', chr(10)), '<[^>]*>', '', 'g'), '^" + _BLANK + "+|" + _BLANK + "+$', '', 'g') AS stripped FROM pages")
def strip_html_basic(spark, sf_dir):
    return mail.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("stripped"))


def _sql_html(x: str) -> str:
    for pattern, by in ((r"(?s)<!--.*?-->", ""), (r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""), (r"(?is)<!doctype[^>]*>", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _sql_entities(x: str) -> str:
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {char})"
    return x


_LINK = r"""(?is)<a\b[^>]*?\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)"""
_HTML_TEXT = "trim(regexp_replace(" + _sql_entities(r"regexp_replace(regexp_replace(t, '(?i)<(?:br|p|div|li|tr|h1|h2|h3)\b[^>]*>|</(?:p|div|li|tr)\s*>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')") + f", '{_BLANK.replace(chr(92) + 'x{09}-' + chr(92) + 'x{0d}', chr(92) + 'x{09}' + chr(92) + 'x{0b}-' + chr(92) + 'x{0d}')}+', ' ', 'g'), ' ' || chr(10))"


@_query(f"WITH h AS (SELECT page_id, {_sql_html('html')} AS t FROM pages), l AS (SELECT page_id, {_HTML_TEXT} AS plain, list_filter(list_transform(regexp_extract_all(t, '{_LINK}', 1), lambda x: {_sql_entities('trim(x, chr(34) || chr(39))')}), lambda x: x <> '') AS links FROM h) SELECT page_id, plain || CASE WHEN len(links) > 0 THEN chr(10) || array_to_string(list_transform(links, lambda x, i: '[' || i || ']: ' || x), chr(10)) ELSE '' END AS plain FROM l")
def html_to_text(spark, sf_dir):
    return mail.table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("plain"))


@_query(f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({_sql_words('text')}) AS w FROM documents) WHERE {_sql_noise('w')} GROUP BY w")
def noise_word_counts(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select(F.explode(X.words(F.col("text"))).alias("word")).filter(X.is_noise(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@_query(f"WITH {_MAIL} SELECT id FROM m WHERE {_URGENT(route.URGENT)}")
def urgent_filter(spark, sf_dir):
    return mail.messages(spark, sf_dir).filter(route.urgent()).select("id")


@_query(f"WITH {_RULED} SELECT id, category, score FROM r")
def classify_rules(spark, sf_dir):
    return _ruled(spark, sf_dir).select("id", "category", "score")


_SURE = R.sql(R.HIGH_CONFIDENCE, "category", "NULL")
_FALL = R.sql(R.FALLBACK, "category", "'Reference'")


@_query(f"WITH {_FEATURES} SELECT id, {_SURE} AS category, {R.sql(R.HIGH_CONFIDENCE, 'score', 'NULL')} AS score FROM f WHERE {_SURE} IS NOT NULL")
def classify_hybrid_rules(spark, sf_dir):
    f = classify.features(mail.messages(spark, sf_dir)).withColumn("r", R.decide(R.HIGH_CONFIDENCE, (None, None)))
    return f.filter(F.col("r.category").isNotNull()).select("id", "r.category", "r.score")


@_query(f"WITH {_FEATURES} SELECT id, {_FALL} AS category, {R.sql(R.FALLBACK, 'score', '0.6')} AS score FROM f")
def classify_hybrid_fallback(spark, sf_dir):
    return classify.features(mail.messages(spark, sf_dir)).withColumn("r", R.decide(R.FALLBACK)).select("id", "r.category", "r.score")


@_query(f"WITH {_FEATURES} SELECT id, coalesce({_SURE}, {_FALL}) AS category, coalesce({R.sql(R.HIGH_CONFIDENCE, 'score', 'NULL')}, {R.sql(R.FALLBACK, 'score', '0.6')}) AS score FROM f")
def classify_hybrid(spark, sf_dir):
    return classify.hybrid(mail.messages(spark, sf_dir)).select("id", "category", "score")


@_query(f"WITH {_FEATURES} SELECT id, CASE WHEN contains(c, 'login') AND contains(c, 'secure') THEN 'Reference' WHEN contains(sub, 'tomorrow') AND NOT contains(c, 'meeting') AND NOT contains(c, 'deadline') THEN 'Reference' WHEN contains(c, 'purchased') OR contains(c, 'pair with') THEN 'Noise' ELSE 'ActionRequired' END AS from_action, CASE WHEN contains(c, 'login') AND (contains(c, 'claude') OR contains(c, 'anthropic')) THEN 'Reference' WHEN contains(c, 'newsletter') OR contains(c, 'unsubscribe') THEN 'Noise' ELSE 'Spam' END AS from_spam FROM f")
def post_process(spark, sf_dir):
    return classify.features(mail.messages(spark, sf_dir)).select("id", classify.corrected(F.lit("ActionRequired")).alias("from_action"), classify.corrected(F.lit("Spam")).alias("from_spam"))


_DRAWN = lambda k: f"(CAST('0x' || substr(md5(id || ':0:{k}'), 1, 8) AS BIGINT) / 4294967296.0)"


@_query(f"WITH {_MAIL} SELECT id, list_extract(['ActionRequired', 'InterestingInfo', 'Reference', 'Noise', 'Spam'], CAST(floor({_DRAWN(1)} * 5) + 1 AS INTEGER)) AS category, CAST(round(0.5 + {_DRAWN(2)} / 2, 9) AS DOUBLE) AS score FROM m")
def classify_random(spark, sf_dir):
    return classify.random(mail.messages(spark, sf_dir)).select("id", "category", F.round("score", 9).alias("score"))


_LABEL = "CASE category WHEN 'ActionRequired' THEN 'Agentic/Action Required' WHEN 'InterestingInfo' THEN 'Agentic/Interesting' WHEN 'Reference' THEN 'Agentic/Reference' WHEN 'Noise' THEN 'Agentic/Low Priority' WHEN 'Spam' THEN 'Agentic/Spam' END"
_REASON = lambda urgent: f"'Rule-based routing: ' || CASE WHEN {urgent} THEN 'urgent content detected, ' ELSE '' END || CASE WHEN score < 0.7 THEN printf('low confidence (%.2f)', score) ELSE 'category: ' || category END || printf(' (confidence: %.2f)', score)"
_ACTIONS = lambda urgent: f"CASE WHEN {urgent} THEN 'Mark as important; Escalate (priority 4): High priority email; ' ELSE '' END || CASE WHEN score < 0.7 THEN 'Apply label ''Agentic/Needs Review''' ELSE 'Apply label ''' || {_LABEL} || '''' || CASE WHEN category IN ('Reference', 'Noise', 'Spam') THEN '; Archive email' ELSE '' END END"
_WHY = lambda urgent: f"CASE WHEN category = 'ActionRequired' THEN 'Action required' WHEN {urgent} THEN 'Urgent content detected' WHEN score < 0.7 THEN printf('Low confidence (%.2f) - needs review', score) ELSE 'Archived based on classification' END"


def _routed(messages: DataFrame) -> DataFrame:
    return route.route(classify.by_rules(messages)).select("id", F.array_join(F.transform("actions", route.described), "; ").alias("actions"), "reasoning")


@_query(f"WITH {_RULED} SELECT id, {_ACTIONS(_URGENT(route.URGENT))} AS actions, {_REASON(_URGENT(route.URGENT))} AS reasoning FROM r")
def route_actions(spark, sf_dir):
    return _routed(mail.messages(spark, sf_dir))


_KEEP = f"(category = 'ActionRequired' OR {_URGENT(route.URGENT_MAIN)} OR score < 0.7)"


@_query(f"WITH {_RULED} SELECT id, {_KEEP} AS stay_in_inbox, {_WHY(_URGENT(route.URGENT_MAIN))} AS why, category <> 'ActionRequired' AS archived FROM r")
def stay_in_inbox(spark, sf_dir):
    return route.decided(_ruled(spark, sf_dir)).select("id", "stay_in_inbox", "why", "archived")


_SUMMARY = f"'Applied label ''' || {_LABEL} || '''' || CASE WHEN category <> 'ActionRequired' THEN ' and archived email' ELSE ' and kept in inbox (ActionRequired)' END"


@_query(f"WITH {_RULED} SELECT id, {_LABEL} AS label_applied, category <> 'ActionRequired' AS archived, {_SUMMARY} AS summary FROM r")
def execute_summary(spark, sf_dir):
    return route.executed(_ruled(spark, sf_dir)).select("id", "label_applied", "archived", "summary")


# --- literal messages, each met by a share of the documents ---
@_query(f"WITH {cases.SQL} SELECT id, category, CAST(score AS DOUBLE) AS score FROM m")
def rules_of_cases(spark, sf_dir):
    return classify.by_rules(cases.messages(spark, sf_dir)).select("id", "category", "score")


@_query(f"WITH {cases.SQL} SELECT id, sure_category AS category, CAST(sure_score AS DOUBLE) AS score FROM m WHERE sure_category IS NOT NULL")
def hybrid_rules_of_cases(spark, sf_dir):
    f = classify.features(cases.messages(spark, sf_dir)).withColumn("r", R.decide(R.HIGH_CONFIDENCE, (None, None)))
    return f.filter(F.col("r.category").isNotNull()).select("id", "r.category", "r.score")


@_query(f"WITH {cases.SQL} SELECT id, fall_category AS category, CAST(fall_score AS DOUBLE) AS score FROM m")
def hybrid_fallback_of_cases(spark, sf_dir):
    return classify.features(cases.messages(spark, sf_dir)).withColumn("r", R.decide(R.FALLBACK)).select("id", "r.category", "r.score")


@_query(f"WITH {cases.SQL} SELECT id, router_urgent, main_urgent, dry_urgent FROM m")
def urgency_of_cases(spark, sf_dir):
    m = route.dry_run(classify.fixed(cases.messages(spark, sf_dir), "Noise", None))
    return m.select("id", route.urgent().alias("router_urgent"), route.urgent(route.URGENT_MAIN).alias("main_urgent"), F.col("urgent").alias("dry_urgent"))


@_query(f"WITH {cases.SQL} SELECT id, {_ACTIONS('router_urgent')} AS actions, {_REASON('router_urgent')} AS reasoning FROM m")
def routes_of_cases(spark, sf_dir):
    return _routed(cases.messages(spark, sf_dir))


@_query(f"WITH {cases.SQL} SELECT id, (category = 'ActionRequired' OR main_urgent OR score < 0.7) AS stay_in_inbox, {_WHY('main_urgent')} AS why, category <> 'ActionRequired' AS archived FROM m")
def inbox_of_cases(spark, sf_dir):
    return route.decided(classify.by_rules(cases.messages(spark, sf_dir))).select("id", "stay_in_inbox", "why", "archived")


@_query(f"WITH {cases.SQL}, a AS (SELECT *, {_LABEL} AS label FROM m), f AS (SELECT label, min(id) AS id FROM a WHERE label NOT LIKE '%e%n%' GROUP BY label) SELECT a.id, a.label AS label_applied, 'Applied label: ' || a.label || CASE WHEN f.id IS NOT NULL THEN '; Created new label: ' || a.label ELSE '' END || CASE WHEN category = 'ActionRequired' THEN '; Kept in inbox (ActionRequired category)' WHEN CAST(a.id AS BIGINT) % 3 = 0 THEN '; Email was already archived' ELSE '; Archived email (removed from inbox)' END AS actions_taken, {_SUMMARY} AS summary FROM a LEFT JOIN f ON f.label = a.label AND f.id = a.id")
def executed_in_mailbox(spark, sf_dir):
    m = classify.by_rules(cases.messages(spark, sf_dir)).withColumn("label_ids", F.when(F.col("id").cast("long") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("INBOX"))))
    had = m.select(route.label_for(F.col("category")).alias("name")).distinct().filter("name LIKE '%e%n%'")
    return route.executed(m, had).select("id", "label_applied", F.array_join("actions_taken", "; ").alias("actions_taken"), "summary")


@_query(f"WITH {cases.SQL}, g AS (SELECT category, count(*) AS processed, count(*) FILTER (category = 'ActionRequired') AS kept, count(*) FILTER (category <> 'ActionRequired') AS archived, count(*) FILTER (dry_urgent) AS urgent FROM m GROUP BY ROLLUP (category)) SELECT category, processed, CAST(0 AS BIGINT) AS errors, kept, archived, urgent, round(processed * 100 / (SELECT max(processed) FROM g), 1) AS share FROM g")
def full_inbox_report(spark, sf_dir):
    run = route.dry_run(classify.by_rules(cases.messages(spark, sf_dir))).withColumn("error", F.lit(None).cast("string"))
    return route.inbox_report(run)


@_query(f"WITH {_RULED} SELECT category, count(*) AS n, round(avg(score), 6) AS mean_score FROM r GROUP BY category")
def category_counts(spark, sf_dir):
    return _ruled(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@_query(f"WITH {_RULED} SELECT category, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY category")
def category_share(spark, sf_dir):
    c = _ruled(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    # a window over the few categories: messages are classified once
    return c.select("category", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@_query(f"WITH {_RULED} SELECT count(*) AS total, count(*) FILTER ({_KEEP}) AS kept, count(*) FILTER (NOT {_KEEP}) AS archived, count(*) FILTER ({_URGENT(route.URGENT_MAIN)}) AS urgent, count(*) FILTER ({_KEEP} AND score < 0.7) AS needs_review FROM r")
def processing_stats(spark, sf_dir):
    return route.stats(route.decided(_ruled(spark, sf_dir)))


@_query(f"WITH {_RULED} SELECT id, score FROM r WHERE score < 0.7")
def review_needed(spark, sf_dir):
    return _ruled(spark, sf_dir).filter("score < 0.7").select("id", "score")


@_query(f"WITH {_RULED} SELECT quality, count(*) AS n, round(avg(CASE WHEN (category = 'Reference') = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r JOIN labels l ON CAST(l.doc_id AS VARCHAR) = r.id GROUP BY quality")
def accuracy_by_label(spark, sf_dir):
    t = mail.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    right = ((F.col("category") == "Reference") == (F.col("quality") == 1)).cast("double")
    return _ruled(spark, sf_dir).select("id", "category").join(t, "id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


@_query("SELECT round(count(text) * 1.0 / count(*), 6) AS text_share, round(count(lang) * 1.0 / count(*), 6) AS lang_share, round(count(source) * 1.0 / count(*), 6) AS source_share FROM documents")
def field_completeness(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").agg(*[F.round(F.count(c) * 1.0 / F.count("*"), 6).cast("double").alias(f"{c}_share") for c in ("text", "lang", "source")])


@_query("SELECT round(avg(octet_length(encode(text))), 6) AS text_bytes, round(avg(octet_length(encode(source))), 6) AS source_bytes FROM documents")
def avg_field_bytes(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").agg(*[F.round(F.avg(F.octet_length(c)), 6).alias(f"{c}_bytes") for c in ("text", "source")])


@_query("SELECT count(*) - count(DISTINCT doc_id) AS duplicates FROM documents")
def duplicate_ids(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").agg((F.count("*") - F.count_distinct("doc_id")).alias("duplicates"))


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def audit_counts(spark, sf_dir):
    return mail.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query(f"WITH {cases.SQL} SELECT category, {_LABEL} AS label, 'TEST_' || {_LABEL} AS test_label, count(*) AS n FROM m GROUP BY category")
def label_dim_lookup(spark, sf_dir):
    c = classify.by_rules(cases.messages(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))
    return c.select("category", route.label_for(F.col("category")).alias("label"), route.test_label(F.col("category")).alias("test_label"), "n")


@_query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT 'label_' || role)), ',') AS labels FROM conversations GROUP BY conv_id")
def explode_labels_join(spark, sf_dir):
    m = mail.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_set("role").alias("label_ids"))
    dim = mail.table(spark, sf_dir, "conversations").select(F.col("role").alias("id"), F.concat(F.lit("label_"), "role").alias("name")).distinct()
    return route.label_names(m, dim).select(F.col("id").alias("conv_id"), F.array_join("labels", ",").alias("labels"))


@_query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Archived' ELSE 'Email was already archived' END AS description, 'UNREAD' AS labels FROM (SELECT DISTINCT conv_id FROM conversations)")
def archive_state(spark, sf_dir):
    m = mail.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("label_ids", F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("INBOX"), F.lit("UNREAD"))).otherwise(F.array(F.lit("UNREAD"))))
    return route.archive(m).select("conv_id", "description", F.array_join("label_ids", ",").alias("labels"))


@_query("SELECT CAST(conv_id AS VARCHAR) AS id, 'INBOX,' || array_to_string(list_sort(list(DISTINCT 'label_agentic/' || role)), ',') AS labels FROM conversations GROUP BY conv_id")
def label_apply_idempotent(spark, sf_dir):
    c = mail.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "role")
    m = c.select("id").distinct().withColumn("label_ids", F.array(F.lit("INBOX")))
    w = c.select(F.col("id").alias("message_id"), F.concat(F.lit("Agentic/"), "role").alias("label"))
    dim = spark.createDataFrame([("INBOX", "INBOX")], "id string, name string")
    return route.apply_labels(m, dim, w)[0].select("id", F.array_join("label_ids", ",").alias("labels"))


@_query("SELECT source FROM (SELECT DISTINCT source FROM documents) WHERE NOT (source IN ('src1', 'src2') OR source LIKE 'Agentic/%' OR source LIKE 'TEST\\_%' ESCAPE '\\')")
def agentic_label_filter(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("source").distinct().filter(~route.own_label(F.col("source"), ("src1", "src2")))


@_query("SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.quality = 1 THEN 'Reference' WHEN l.quality = 0 THEN 'Noise' END AS category, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def replay_join(spark, sf_dir):
    m = mail.messages(spark, sf_dir)
    labels = mail.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "Reference").otherwise("Noise").alias("category"), F.lit(1.0).alias("score"), F.lit("").alias("response"), F.lit("2020-01-01").alias("recorded_at"))
    return classify.replay(m, m.select(*classify.SIGNATURE).join(labels, "id")).select("id", "category", F.col("error").isNotNull().alias("missing"))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Noise' END AS category FROM documents")
def llm_json_parse(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 3 == 0, 'Sure: {"category": "Noise", "score": 0.5, "explanation": "x"} .').when(F.col("doc_id") % 3 == 1, '{"category": "Odd", "score": 0.5, "explanation": "x"}').otherwise("no object")
    return mail.table(spark, sf_dir, "documents").select("doc_id", classify.parse_reply(reply)["category"].alias("category"))


# --- spans in DuckDB's dialect: matches, gaps between them, and the first overlap's winner, one span after the other ---
_QUOTED = lambda p: p.replace("'", "''")


def _sql_places(text: str, pattern: str, kind: str) -> str:
    p = _QUOTED(pattern.replace(r"\s", _BLANK).replace(r"\d", r"\p{Nd}"))
    return f"list_transform(range(1, len(regexp_extract_all({text}, '{p}')) + 1), lambda k: {{'s': list_sum(list_transform(string_split_regex({text}, '{p}')[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{p}')[1:k - 1], lambda h: length(h))), 0), 'kind': '{kind}', 't': regexp_extract_all({text}, '{p}')[k]}})"


_SPAN_END = lambda x: f"{x}.s + length({x}.t)"


def _sql_merged(found: str, wins: str, typed: str = "STRUCT(s HUGEINT, kind VARCHAR, t VARCHAR)") -> str:
    """wins: over x[1] (new) and o (old)."""
    hit = f"x[1].s < {_SPAN_END('o')} AND o.s < {_SPAN_END('x[1]')}"
    first = f"coalesce(list_position(list_transform(acc, lambda o: {hit}), true), 0)"
    return f"list_reduce([CAST([] AS {typed}[])] || list_transform({found}, lambda y: [y]), lambda acc, x: CASE WHEN {first} = 0 THEN acc || x ELSE list_transform(acc, lambda o, i: CASE WHEN i = {first} AND ({wins}) THEN x[1] ELSE o END) END)"


_BYTES = lambda x: f"octet_length(encode({x}))"
_LONGER = f"{_BYTES('x[1].t')} > {_BYTES('o.t')}"
_DIGITS = "regexp_replace(trim(split_part(f.t, 'ext', 1)), '[^0-9]', '', 'g')"
_PHONE_OK = f"CASE WHEN starts_with(trim(f.t), '+') AND length({_DIGITS}) BETWEEN 7 AND 15 THEN true ELSE regexp_full_match({_DIGITS}, '1?[2-9][0-9]{{9}}') END"
_PLAIN_MAIL = "replace(replace(replace(replace(trim(f.t, '<>\"'), '[at]', '@'), '(at)', '@'), '[dot]', '.'), '(dot)', '.')"
_EMAIL_OK = f"len(string_split({_PLAIN_MAIL}, '@')) = 2 AND {_BYTES(f'split_part({_PLAIN_MAIL}, {chr(39)}@{chr(39)}, 1)')} BETWEEN 1 AND 64 AND {_BYTES(f'split_part({_PLAIN_MAIL}, {chr(39)}@{chr(39)}, 2)')} BETWEEN 1 AND 253 AND regexp_full_match(split_part({_PLAIN_MAIL}, '@', 2), '(?s)[^.]+(\\.[^.]+)*\\.[^.]{{2,}}')"
_LOCATION_OK = r"NOT regexp_matches(f.t, '\b[1-9][0-9]{3}\b') AND ((regexp_matches(f.t, '^[0-9]+[ ]') AND coalesce(TRY_CAST(regexp_extract(f.t, '^[0-9]+') AS BIGINT), 0) BETWEEN 1000 AND 99999) OR regexp_matches(f.t, 'mann|berg|hof|weg|gasse|strasse|str\.') OR (contains(f.t, '-') AND octet_length(encode(f.t)) <= 8))"


def _sql_found(text: str, kind: str, patterns: list[str], ok: str) -> str:
    every = " || ".join(_sql_places(text, p, kind) for p in patterns)
    return f"list_sort({_sql_merged(f'list_filter({every}, lambda f: {ok})', _LONGER)})"


_CITY = r"\b(?:" + "|".join(c.replace(".", r"\.") for c in pii.CITIES) + r")\b"
#: Texts that hold none of what patterns begin with have no span: what is costly is made for the others alone.
_MAYBE = rf"regexp_matches(text, '[0-9@]|\[at\]|\(at\)|{_QUOTED(_CITY)}')"


def _sql_spans(source: str, key: str) -> str:
    """p (key, text, phones, emails, places, cities), e (key, text, spans): resolved spans of the rows of source that have any."""
    return f"""p AS MATERIALIZED (SELECT {key}, text, {_sql_found('text', 'phone', pii.PHONE, _PHONE_OK)} AS phones, {_sql_found('text', 'email', pii.EMAIL, _EMAIL_OK)} AS emails, {_sql_found('text', 'location', pii.LOCATION, _LOCATION_OK)} AS places, {_sql_places('text', _CITY, 'location')} AS cities FROM {source} WHERE {_MAYBE}),
q AS MATERIALIZED (SELECT {key}, text, phones, emails, list_sort(places || list_filter(cities, lambda c: len(list_filter(places, lambda o: c.s < {_SPAN_END('o')} AND o.s < {_SPAN_END('c')})) = 0)) AS places FROM p),
e AS MATERIALIZED (SELECT {key}, text, {_sql_merged('list_sort(list_transform(phones || emails || places, lambda y, i: {"s": y.s, "i": i, "y": y}))'.replace(chr(34), chr(39)).replace("list_sort(", "list_transform(list_sort(", 1) + ", lambda z: z.y)", _LONGER)} AS spans FROM q)"""


_EXPLODED = "x AS (SELECT doc_id, text, unnest(spans) AS z FROM e)"


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(mail.table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query(f"WITH {_sql_spans('documents', 'doc_id')} SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(emails) AS m FROM q) GROUP BY doc_id")
def email_spans_text(spark, sf_dir):
    found = mail.table(spark, sf_dir, "documents").select("doc_id", F.size(pii.email_spans(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    return found.filter("n > 0")


@_query(f"WITH {_sql_spans('documents', 'doc_id')} SELECT doc_id, m.t AS phone, CAST(m.s AS BIGINT) AS start, CAST({_SPAN_END('m')} AS BIGINT) AS \"end\" FROM (SELECT doc_id, unnest(phones) AS m FROM q)")
def phone_spans_text(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("doc_id", F.explode(pii.phone_spans(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", F.col("s.text").alias("phone"), "s.start", "s.end")


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED} SELECT doc_id, z.kind AS pii_type, z.t AS found, CAST(z.s AS BIGINT) AS start, CAST({_SPAN_END('z')} AS BIGINT) AS \"end\", CAST({_BYTES('substring(text, 1, CAST(z.s AS BIGINT))')} AS BIGINT) AS byte_start FROM x")
def pii_spans(spark, sf_dir):
    return _detected(spark, sf_dir).select("doc_id", F.explode("entities").alias("e"), "text").select("doc_id", "e.pii_type", F.col("e.text").alias("found"), "e.start", "e.end", pii.byte_offset(F.col("text"), F.col("e.start").cast("int")).alias("byte_start"))


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED} SELECT z.kind AS pii_type, count(*) AS n FROM x GROUP BY z.kind")
def pii_counts_by_type(spark, sf_dir):
    return _detected(spark, sf_dir).select(F.explode("entities.pii_type").alias("pii_type")).groupBy("pii_type").agg(F.count("*").alias("n"))


_PICK = lambda words, by: f"list_extract([{', '.join(chr(39) + w + chr(39) for w in words)}], CAST(seed * {by} % {len(words)} + 1 AS INTEGER))"
_MADE = f"{_PICK(fake.USERS, 11)} || CAST(seed % 999 + 1 AS VARCHAR) || '@' || {_PICK(fake.DOMAINS, 7)}"
_SPELT = lambda a, d: f"replace(replace({_MADE}, '@', ' {a} '), '.', ' {d} ')"
_STAND_IN = f"""CASE kind WHEN 'phone' THEN '(' || {_PICK(fake.AREAS, 11)} || ') ' || CAST(1000 + seed % 900 AS VARCHAR) || '-' || CAST(1000 + seed * 17 % 9000 AS VARCHAR)
 WHEN 'email' THEN CASE WHEN text LIKE '<%>' THEN '<' || {_MADE} || '>' WHEN text LIKE '"%"' THEN '"' || {_MADE} || '"' WHEN contains(text, '[at]') THEN {_SPELT('[at]', '[dot]')} WHEN contains(text, '(at)') THEN {_SPELT('(at)', '(dot)')} ELSE {_MADE} END
 ELSE CASE WHEN regexp_matches(text, '^[0-9]') THEN {_PICK(fake.POSTAL, 7)} || ' ' || {_PICK(fake.CITIES, 11)} WHEN regexp_matches(text, 'mann|gasse|str') THEN CAST(100 + seed % 900 AS VARCHAR) || ' ' || {_PICK(fake.STREETS, 13)} ELSE {_PICK(fake.PLACES, 17)} END END"""


def _sql_dictionary(spans: str, order: str) -> str:
    """d (text, kind, seed, stand_in) from spans (z and the columns of order)."""
    return f"o AS (SELECT z.t AS text, arg_min(z.kind, {order}) AS kind, min({order}) AS place FROM {spans} GROUP BY z.t), n AS (SELECT text, kind, row_number() OVER (ORDER BY place) - 1 AS seed FROM o), d AS MATERIALIZED (SELECT text, kind, seed, {_STAND_IN} AS stand_in FROM n)"


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED}, {_sql_dictionary('x', '(doc_id, z.s)')} SELECT text, kind AS pii_type, seed, stand_in FROM d")
def replacement_map(spark, sf_dir):
    return pii.mapping(_detected(spark, sf_dir), "doc_id").select("text", "pii_type", "seed", "stand_in")


def _sql_written(key: str) -> str:
    """r (key, new, log): texts with stand-ins, from x (key, text, z) and d, spans that don't overlap."""
    gap = "substring(text, CAST(coalesce({end}, 0) AS BIGINT) + 1, CAST(z.s - coalesce({end}, 0) AS BIGINT))".format(end=f"lag({_SPAN_END('z')}) OVER (PARTITION BY {key} ORDER BY z.s)")
    return f"y AS (SELECT {key}, x.text AS whole, z.s AS s, {_SPAN_END('z')} AS stop, {gap.replace('substring(text', 'substring(x.text')} AS gap, z.kind AS kind, z.t AS original, stand_in FROM x JOIN d ON d.text = z.t), r AS (SELECT {key}, string_agg(gap || stand_in, '' ORDER BY s) || substring(any_value(whole), CAST(max(stop) AS BIGINT) + 1) AS new, count(*) AS n FROM y GROUP BY {key})"


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED}, {_sql_dictionary('x', '(doc_id, z.s)')}, {_sql_written('doc_id')} SELECT doc_id, CASE WHEN r.doc_id IS NULL THEN text ELSE new END AS replaced, coalesce(n, 0) AS n FROM documents LEFT JOIN r USING (doc_id)")
def replaced_text(spark, sf_dir):
    return pii.replaced(_detected(spark, sf_dir), "doc_id").select("doc_id", F.col("text").alias("replaced"), F.size("replacements").cast("long").alias("n"))


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED}, {_sql_dictionary('x', '(doc_id, z.s)')}, {_sql_written('doc_id')} SELECT doc_id, kind AS pii_type, original, stand_in, CAST(sum({_BYTES('gap')}) OVER w + coalesce(sum({_BYTES('stand_in')}) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING)")
def replacement_log(spark, sf_dir):
    return pii.replaced(_detected(spark, sf_dir), "doc_id").select("doc_id", F.explode("replacements").alias("r")).select("doc_id", "r.pii_type", "r.original", "r.stand_in", "r.position")


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_AT = lambda words, by: f"list_extract({_LIST(words)}, CAST(doc_id * {by} % {len(words)} + 1 AS INTEGER))"


@_query(f"SELECT doc_id, {_AT(fake.FIRST, 7)} || ' ' || {_AT(fake.LAST, 13)} AS name, {_AT(fake.USERS, 11)} || CAST(doc_id % 999 + 1 AS VARCHAR) || '@' || {_AT(fake.DOMAINS, 7)} AS email, '(' || {_AT(fake.AREAS, 11)} || ') ' || CAST(1000 + doc_id % 900 AS VARCHAR) || '-' || CAST(1000 + doc_id * 17 % 9000 AS VARCHAR) AS phone, CAST(100 + doc_id % 900 AS VARCHAR) || ' ' || {_AT(fake.STREETS, 19)} || ', ' || {_AT(fake.CITIES, 23)} || ', ' || {_AT(fake.STATES, 29)} || ' ' || CAST(10000 + doc_id % 90000 AS VARCHAR) AS address, {_AT(fake.PLACES, 17)} AS place, {_AT(fake.COMPANIES, 31)} AS company FROM documents")
def fake_values(spark, sf_dir):
    s = F.col("doc_id")
    return mail.table(spark, sf_dir, "documents").select("doc_id", fake.name(s).alias("name"), fake.email(F.lit("a@b.c"), s).alias("email"), fake.phone(s).alias("phone"), fake.address(s).alias("address"), fake.location(F.lit("Bern"), s).alias("place"), fake.company(s).alias("company"))


@_query(f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '{pii.REAL_EMAIL}'), lambda e: NOT contains(e, 'example.com') AND NOT contains(e, 'user'))) > 0 AS real_email, len(list_filter(regexp_extract_all(text, '{pii.REAL_PHONE}'), lambda p: NOT contains(p, '555'))) > 0 AS real_phone FROM documents")
def spot_check_pii(spark, sf_dir):
    t = F.col("text")
    return mail.table(spark, sf_dir, "documents").select("doc_id", pii.suspicious_emails(t).alias("real_email"), pii.suspicious_phones(t).alias("real_phone"))


_TRIMMED = f"list_transform(string_split_regex(text, '{_BLANK}+'), lambda w: lower(regexp_replace(w, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')))"


@_query("SELECT doc_id, " + " OR ".join(f"(contains(text, '{n}') AND list_contains({_TRIMMED}, '{n.lower()}'))" for n in pii.FIRST_NAMES) + " AS real_name FROM documents")
def spot_check_names(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("doc_id", pii.suspicious_names(F.col("text")).alias("real_name"))


@_query(f"WITH {_MAIL} SELECT field, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM (SELECT unnest(['subject', 'from', 'body', 'snippet']) AS field, unnest([subject, sender, body, snippet]) AS value FROM m) WHERE value IS NOT NULL GROUP BY field")
def text_fields(spark, sf_dir):
    return pii.text_fields(mail.messages(spark, sf_dir)).groupBy("field").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_JUDGED = "j AS (SELECT r.id, category, CASE WHEN quality = 1 THEN 'Reference' ELSE 'Noise' END AS truth FROM r JOIN labels l ON CAST(l.doc_id AS VARCHAR) = r.id)"


@_query(f"WITH {_RULED}, {_JUDGED} SELECT truth, count(*) AS n, count(*) FILTER (category = truth) AS correct, round(avg(CASE WHEN category = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j GROUP BY ROLLUP (truth)")
def accuracy_overall(spark, sf_dir):
    return analysis.accuracy(_judged(spark, sf_dir))


@_query(f"WITH {_RULED}, {_JUDGED} SELECT * FROM j WHERE category <> truth")
def misclassified(spark, sf_dir):
    return analysis.misclassified(_judged(spark, sf_dir))


@_query(f"WITH {_RULED}, {_JUDGED} SELECT count(*) FILTER (category = 'Spam' AND truth <> 'Spam') AS false_spam FROM j")
def false_spam(spark, sf_dir):
    return analysis.false_spam(_judged(spark, sf_dir))


@_query(f"WITH {_RULED} SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS categories, round(max(k) / sum(k), 6) AS largest_share FROM (SELECT category, count(*) AS k FROM r GROUP BY category)")
def largest_share(spark, sf_dir):
    return analysis.largest_share(_ruled(spark, sf_dir))


@_query("SELECT lang || '.example.com' AS domain, split_part(text, chr(10), 1) AS subject, count(*) AS n FROM documents GROUP BY ALL")
def subjects_by_domain(spark, sf_dir):
    return analysis.subjects_by_domain(mail.messages(spark, sf_dir))


@_query("SELECT count(*) AS n, array_to_string(list_sort(list(DISTINCT CASE WHEN quality = 1 THEN 'Reference' ELSE 'Noise' END)), ',') AS categories FROM labels")
def recording_stats(spark, sf_dir):
    return analysis.recording_stats(mail.table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "Reference").otherwise("Noise").alias("category")))


_QUIET = "category IN ('Reference', 'Noise', 'Spam') AND score >= 0.7"


@_query(f"WITH {_RULED}, u AS (SELECT id, {_URGENT(route.URGENT)} AS high, CASE WHEN score < 0.7 THEN ['Apply label ''Agentic/Needs Review'''] ELSE ['Apply label ''' || {_LABEL} || ''''] END || CASE WHEN {_QUIET} THEN ['Archive email'] ELSE [] END AS texts FROM r), w AS (SELECT id, high, CASE WHEN high THEN ['Mark as important', 'Escalate (priority 4): High priority email'] ELSE [] END || texts AS texts FROM u) SELECT id, high, CASE WHEN len(texts) = 1 THEN texts[1] ELSE CAST(len(texts) AS VARCHAR) || ' actions: ' || array_to_string(texts, ', ') END AS summary FROM w")
def actions_summary(spark, sf_dir):
    return route.route(_ruled(spark, sf_dir)).select("id", route.any_high_priority(F.col("actions")).alias("high"), route.summary(F.col("actions")).alias("summary"))


@_query("SELECT doc_id, CASE WHEN lang IN ('ActionRequired', 'InterestingInfo', 'Reference', 'Noise', 'Spam') THEN NULL ELSE 'Invalid email category ''' || coalesce(lang, '') || '''. Valid categories: ActionRequired, InterestingInfo, Reference, Noise, Spam' END AS error FROM documents")
def category_errors(spark, sf_dir):
    return mail.table(spark, sf_dir, "documents").select("doc_id", route.category_error(F.col("lang")).alias("error"))


@_query(f"WITH {_MAIL} SELECT id FROM m ORDER BY id LIMIT 10")
def first_n_limit(spark, sf_dir):
    return mail.inbox(mail.messages(spark, sf_dir), 10).select("id")


@_query("SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS seed FROM documents GROUP BY source")
def first_seen_seed(spark, sf_dir):
    return route.first_seen(mail.table(spark, sf_dir, "documents"), "source", ["doc_id"])


@_query(f"WITH {_MAIL} SELECT id, subject IS NOT NULL AS has_subject, CASE WHEN octet_length(encode(subject)) > 50 THEN substring(subject, 1, len(list_filter(range(1, 48), lambda n: octet_length(encode(substring(subject, 1, n))) <= 47))) || '...' ELSE subject END AS shown FROM m")
def manifest_preview(spark, sf_dir):
    return mail.messages(spark, sf_dir).select("id", F.col("subject").isNotNull().alias("has_subject"), X.truncated(F.col("subject")).alias("shown"))


# --- spans across rows ---
_RAW = "w AS (SELECT doc_id, unnest(" + " || ".join(_sql_places("text", p, "email").replace("'kind': 'email'", f"'kind': 'email{k}'") for k, p in enumerate(pii.EMAIL[:4])) + ") AS z FROM documents WHERE contains(text, '@')), v AS (SELECT doc_id, z.kind AS pattern, z.t AS text, CAST(z.s AS BIGINT) AS start, CAST(z.s + length(z.t) AS BIGINT) AS stop FROM w)"


def _raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pattern, text, start, end of every match of each of four patterns, before overlaps are settled."""
    t = F.col("text")
    every = F.concat(*[spans.places(t, p, f"email{k}") for k, p in enumerate(pii.EMAIL[:4])])
    rows = mail.table(spark, sf_dir, "documents").filter(t.contains("@")).select("doc_id", F.explode(every).alias("s"))
    return rows.select("doc_id", F.col("s.pii_type").alias("pattern"), "s.text", "s.start", "s.end")


@_query(f"WITH {_RAW} SELECT a.doc_id, a.pattern, b.pattern AS pattern2, a.start, a.stop AS \"end\", b.start AS start2, b.stop AS end2 FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.pattern < b.pattern AND a.start < b.stop AND b.start < a.stop")
def span_overlaps(spark, sf_dir):
    raw = _raw_matches(spark, sf_dir)
    return spans.overlapping(raw, raw, ["doc_id"]).filter("pattern < pattern2").select("doc_id", "pattern", "pattern2", "start", "end", "start2", "end2")


@_query(f"WITH {_RAW}, h AS (SELECT *, CASE WHEN start >= coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS UNBOUNDED PRECEDING) AS chain FROM h) SELECT doc_id, CAST(chain AS BIGINT) AS chain, count(*) AS n, min(start) AS start, max(stop) AS \"end\" FROM g GROUP BY doc_id, chain")
def span_groups(spark, sf_dir):
    return spans.overlap_groups(_raw_matches(spark, sf_dir), ["doc_id"], "chain").groupBy("doc_id", "chain").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


# --- known originals, wherever they stand ---
@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED}, d AS (SELECT z.t AS known, min(z.kind) AS pii_type FROM x GROUP BY z.t), j AS (SELECT doc_id, known, pii_type, len(list_filter(range(1, length(text) - length(known) + 2), lambda p: substring(text, p, length(known)) = known)) AS n FROM documents JOIN d ON contains(text, known)) SELECT doc_id, known, pii_type, CAST(n AS BIGINT) AS n FROM j")
def known_occurrences(spark, sf_dir):
    docs = mail.table(spark, sf_dir, "documents").select("doc_id", "text")
    table = _detected(spark, sf_dir).select(F.explode("entities").alias("e")).select("e.text", "e.pii_type")
    return known.occurrences(docs, table, "doc_id").groupBy("doc_id", F.col("text").alias("known"), "pii_type").agg(F.count("*").alias("n"))


# --- the mailbox as a source ---
def _exported(spark: SparkSession, sf_dir: str) -> str:
    """documents as a mailbox export: every third unread, every fiftieth line cut in two."""
    d = mail.messages(spark, sf_dir)
    n = F.col("id").cast("long")
    labels = F.when(n % 3 == 0, F.array(F.lit("INBOX"), F.lit("UNREAD"))).otherwise(F.array(F.lit("INBOX")))
    at = f"{store.shared_dir(spark)}/mailbox-{uuid.uuid4().hex}"
    mailbox.register(spark)
    mailbox.export(d.withColumn("label_ids", labels), at, cut=n % 50 == 7)
    return at


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 50 = 7 AS failed, CASE WHEN doc_id % 50 <> 7 THEN 'INBOX,UNREAD' ELSE '' END AS labels FROM documents WHERE doc_id % 3 = 0 OR doc_id % 50 = 7")
def mailbox_unread(spark, sf_dir):
    return mailbox.unread(spark, _exported(spark, sf_dir), None).select("id", F.col("error").isNotNull().alias("failed"), F.array_join("label_ids", ",").alias("labels"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS subject, source || '@' || lang || '.example.com' AS sender, 'Desk <' || source || '@List.example.com>' AS recipient, text AS body, substring(text, 1, 200) AS snippet FROM documents WHERE doc_id % 50 <> 7")
def mailbox_messages(spark, sf_dir):
    raw = spark.read.format("mailbox").load(_exported(spark, sf_dir)).filter("error IS NULL")
    return mime.parse_messages(raw).select("id", "subject", F.col("from").alias("sender"), F.array_join("to", ", ").alias("recipient"), "body", "snippet")


@_query(f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 7 WHEN 2 THEN trim(text, {_TRIMS}) WHEN 3 THEN trim(text, {_TRIMS}) WHEN 4 THEN 'own ' || text WHEN 5 THEN 'deep ' || text WHEN 6 THEN 'snip' ELSE text END AS body FROM documents")
def message_bodies(spark, sf_dir):
    """Messages of seven shapes: a plain part, encoded ones, nested ones to a depth of six, a body of its own, none at all."""
    t, k = F.col("text"), F.col("doc_id") % 7
    code = F.translate(F.base64(F.encode(t, "utf-8")), "+/\r\n", "-_")
    part = lambda kind, data, parts="null": F.concat(F.lit(f'{{"mimeType":"{kind}","body":{{"data":'), data, F.lit('},"parts":'), F.lit(parts) if isinstance(parts, str) else parts, F.lit("}"))
    said = lambda c: F.get(F.split(F.to_json(F.struct(c.alias("x"))), '^\\{"x":|\\}$'), 1)
    null, listed = F.lit("null"), lambda *p: F.concat(F.lit("["), F.concat_ws(",", *p), F.lit("]"))
    deep = part("text/plain", said(F.concat(F.lit("deep "), t)))
    for _ in range(6):
        deep = part("multipart/mixed", null, listed(deep))
    late = part("text/plain", said(F.lit("late")))
    parts = F.when(k == 0, listed(part("text/html", said(F.lit("x"))), part("text/plain", said(t)))).when(k == 1, listed(part("image/png", null), part("text/plain", said(t)))).when(k == 2, listed(part("text/html", said(code)))).when(k == 3, listed(part("multipart/x", null, listed(part("text/html", said(code)))), late)).when(k == 4, listed(part("text/html", said(F.lit("<p>not encoded</p>"))))).when(k == 5, listed(deep)).otherwise("null")
    own = F.when(k == 4, said(F.concat(F.lit("own "), t))).otherwise("null")
    raw = F.concat(F.lit('{"id":"'), F.col("doc_id").cast("string"), F.lit('","snippet":"snip","payload":{"body":{"data":'), own, F.lit('},"parts":'), parts, F.lit("}}"))
    return mime.parse_messages(mail.table(spark, sf_dir, "documents").select(raw.alias("raw"))).select("id", "body")


# --- a model as a stage ---
def _model(prompts: list[str]) -> list[str]:
    """Stands in for a model: an answer by the prompt's length; one length in eleven fails."""
    if any(len(p) % 11 == 3 for p in prompts):
        raise OSError("no model")
    kinds = ("ActionRequired", "InterestingInfo", "Reference", "Noise", "Spam", "Odd")
    return [f'Sure: {{"category": "{kinds[len(p) % 6]}", "score": 0.5, "explanation": "{len(p)}"}}' for p in prompts]


_PROMPT = f"'Sort this message into one of ActionRequired, InterestingInfo, Reference, Noise, Spam. Answer with a JSON object of category, score (0 to 1) and explanation.' || chr(10) || 'from_domain:' || lang || '.example.com to_domain:list.example.com' || chr(10) || {_sql_prepared(200)}"


@_query(f"WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, split_part(text, chr(10), 1) AS subject, substring(text, 1, 200) AS snippet, text AS body FROM documents), p AS (SELECT id, length({_PROMPT}) AS n FROM m) SELECT id, CASE WHEN n % 11 <> 3 AND n % 6 < 5 THEN list_extract(['ActionRequired', 'InterestingInfo', 'Reference', 'Noise', 'Spam'], CAST(n % 6 + 1 AS INTEGER)) END AS category, CASE WHEN n % 11 <> 3 AND n % 6 < 5 THEN 'LLM Response: ' || n || ' (Score: 0.50)' END AS response, CASE WHEN n % 11 = 3 THEN 'OSError: no model' WHEN n % 6 = 5 THEN 'no valid answer in the reply' END AS error FROM p")
def classify_model(spark, sf_dir):
    return classify.by_model(mail.messages(spark, sf_dir), _model).select("id", "category", "response", "error")


def _nobody(prompts: list[str]) -> list[str]:
    """Stands in for a model that finds no name and no address."""
    return ["[]"] * len(prompts)


@_query(f"WITH {_MAIL}, u AS (SELECT id, unnest([0, 1, 2]) AS field, unnest([subject, snippet, body]) AS text FROM m), {_sql_spans('u', 'id, field')}, x AS (SELECT id, field, text, unnest(spans) AS z FROM e), {_sql_dictionary('x', '(id, field, z.s)')}, {_sql_written('id, field')}, s AS (SELECT u.id, u.field, CASE WHEN r.id IS NULL THEN text ELSE new END AS text, coalesce(n, 0) AS n FROM u LEFT JOIN r USING (id, field)) SELECT id, any_value(text) FILTER (field = 0) AS subject, any_value(text) FILTER (field = 1) AS snippet, any_value(text) FILTER (field = 2) AS body, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY id")
def anonymised_messages(spark, sf_dir):
    done, _ = names.anonymised(mail.messages(spark, sf_dir), _nobody, order=("id",))
    return done.select("id", "subject", "snippet", "body", F.size("replacements").cast("long").alias("n"))


# --- counters of the pass that works ---
@_query(f"WITH {cases.SQL} SELECT count(*) AS total, count(*) FILTER (NOT f AND k) AS kept, count(*) FILTER (NOT f AND NOT k) AS archived, count(*) FILTER (NOT f AND main_urgent) AS urgent, count(*) FILTER (NOT f AND k AND score < 0.7) AS needs_review, count(*) FILTER (f) AS errors FROM (SELECT CAST(id AS BIGINT) % 13 = 5 AS f, (category = 'ActionRequired' OR main_urgent OR score < 0.7) AS k, main_urgent, score FROM m)")
def observed_counters(spark, sf_dir):
    d = route.decided(classify.by_rules(cases.messages(spark, sf_dir))).withColumn("error", F.when(F.col("id").cast("long") % 13 == 5, "down"))
    rows, watch = progress.observed(d)
    store.stored(rows.select("id", "category", "why"), "decided")
    got = watch.get
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{c} long" for c in got))


@_query("WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS id, lower(split_part(text, chr(10), 1)) AS s, source || CASE doc_id % 8 WHEN 0 THEN '@github.com' WHEN 1 THEN '@linkedin.com' WHEN 2 THEN '@facebookmail.com' WHEN 3 THEN '@nytimes.com' WHEN 4 THEN '@spotify.com' WHEN 5 THEN '@smood.ch' WHEN 6 THEN 'no-reply@accounts.google.com' ELSE '@x.example' END AS f FROM documents) SELECT CASE WHEN contains(f, 'github.com') OR contains(s, 'run failed') THEN 'dev_notifications' WHEN contains(f, 'linkedin.com') THEN 'social_professional' WHEN contains(f, 'facebook') THEN 'social_personal' WHEN contains(s, 'security alert') OR contains(f, 'no-reply@accounts.google.com') THEN 'security' WHEN contains(f, 'flipboard') OR contains(f, 'nytimes') OR contains(f, 'uefa') THEN 'newsletter' WHEN contains(f, 'spotify') THEN 'entertainment' WHEN contains(s, 'rental') OR contains(s, 'request') THEN 'business' WHEN contains(f, 'smood') THEN 'shopping' ELSE 'other' END AS bucket, count(*) AS n FROM m GROUP BY 1")
def content_buckets(spark, sf_dir):
    k = F.col("id").cast("long") % 8
    sender = F.element_at(F.array(*map(F.lit, ("@github.com", "@linkedin.com", "@facebookmail.com", "@nytimes.com", "@spotify.com", "@smood.ch", "no-reply@accounts.google.com", "@x.example"))), (k + 1).cast("int"))
    m = mail.messages(spark, sf_dir).withColumn("from", F.concat(F.split_part("from", F.lit("@"), F.lit(1)), sender))
    return m.groupBy(analysis.content_bucket().alias("bucket")).agg(F.count("*").alias("n"))


# --- small operators over the tables ---
@_query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS sent_at FROM events")
def sent_dates(spark, sf_dir):
    head = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "EEE, dd MMM yyyy HH:mm:ss '+0200 (CEST)'"))
    rows = mime.sent_at(mail.table(spark, sf_dir, "events").select("event_id", head.alias("sent")))
    return rows.select("event_id", F.date_format("sent_ts", "yyyy-MM-dd HH:mm:ss").alias("sent_at"))


@_query(f"WITH {_MAIL}, d AS (SELECT doc_id, source FROM documents) SELECT m.id, 'Subject: ' || subject || chr(10) || 'From: ' || sender || chr(10) || 'To: Desk <' || source || '@List.example.com>' || chr(10) || 'Body: ' || body || chr(10) || 'Snippet: ' || snippet AS flat, CASE WHEN subject <> '' THEN subject END AS subject, sender FROM m JOIN d ON CAST(doc_id AS VARCHAR) = m.id")
def flattened_messages(spark, sf_dir):
    flat = mail.messages(spark, sf_dir).select("id", mail.flattened().alias("flat"))
    return mail.rebuilt(flat, "flat").select("id", "flat", "subject", F.col("from").alias("sender"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS subject, lang AS sender, 'a@b.example|c@d.example' AS recipients, CASE WHEN doc_id % 2 = 0 THEN 'Fri' END AS sent FROM documents")
def header_projections(spark, sf_dir):
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    many = F.array(h("X-Other", F.lit("x")), h("SUBJECT", F.col("source")), h("subject", F.lit("second")), h("From", F.col("lang")), h("tO", F.lit(" a@b.example ,c@d.example")))
    d = mail.table(spark, sf_dir, "documents").withColumn("headers", F.when(F.col("doc_id") % 2 == 0, F.concat(many, F.array(h("Date", F.lit("Fri"))))).otherwise(many))
    return mail.headers(d).select(F.col("doc_id").cast("string").alias("id"), "subject", F.col("from").alias("sender"), F.array_join("to", "|").alias("recipients"), "sent")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, labels): conversations whose label ids are their roles' and a few of their own."""
    c = mail.table(spark, sf_dir, "conversations")
    own = F.concat(F.when(F.col("role") == "user", "Agentic/").when(F.col("role") == "assistant", "TEST_").otherwise(""), F.col("role"))
    rows = c.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("label_"), F.col("role")).alias("label"), own.alias("name"))
    m = rows.groupBy("id").agg(F.collect_set("label").alias("label_ids")).withColumn("label_ids", F.array_append("label_ids", F.lit("INBOX")))
    dim = rows.select(F.col("label").alias("id"), "name").distinct().unionByName(spark.createDataFrame([("INBOX", "INBOX")], "id string, name string"))
    return m, dim


@_query("SELECT CAST(conv_id AS VARCHAR) AS id, array_to_string(list_sort(['INBOX'] || coalesce(list(DISTINCT 'label_' || role) FILTER (role NOT IN ('user', 'assistant')), [])), ',') AS labels FROM conversations GROUP BY conv_id")
def label_cleanup(spark, sf_dir):
    m, dim = _labelled(spark, sf_dir)
    left, _ = route.drop_labels(m, dim, route.own_label(F.col("name")))
    return left.select("id", F.array_join(F.sort_array("label_ids"), ",").alias("labels"))


@_query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE role = 'system'")
def messages_by_label(spark, sf_dir):
    m, dim = _labelled(spark, sf_dir)
    return route.by_label(m, dim, "system")[0].select("id")


_NUMBER = "CASE doc_id % 5 WHEN 0 THEN '+' || repeat('7', CAST(doc_id % 19 AS INTEGER)) WHEN 1 THEN '(' || CAST(100 + doc_id % 900 AS VARCHAR) || ') 555-0100' WHEN 2 THEN '1' || CAST(1000000000 + doc_id * 7919 % 9000000000 AS VARCHAR) WHEN 3 THEN CAST(doc_id AS VARCHAR) || '-22' ELSE CAST(200 + doc_id % 800 AS VARCHAR) || '-555-0100 ext 9' END"
_ADDRESS = "CASE doc_id % 6 WHEN 0 THEN repeat('a', CAST(doc_id % 70 AS INTEGER)) || '@b.example' WHEN 1 THEN '<x@y.' || substr('abc', 1, CAST(doc_id % 4 AS INTEGER)) || '>' WHEN 2 THEN 'x [at] y [dot] zz' WHEN 3 THEN 'a@b@c.example' WHEN 4 THEN 'a@b..example' ELSE 'nobody' END"
_PLACE = "CASE doc_id % 6 WHEN 0 THEN CAST(doc_id AS VARCHAR) || ' Bern' WHEN 1 THEN 'Hofweg ' || CAST(doc_id AS VARCHAR) WHEN 2 THEN 'A-' || CAST(doc_id AS VARCHAR) WHEN 3 THEN lpad(CAST(doc_id AS VARCHAR), 5, '0') || ' Ort' WHEN 4 THEN 'Ort' ELSE 'Bergstrasse ' || CAST(doc_id AS VARCHAR) || 'b' END"


@_query(f"SELECT doc_id, {_PHONE_OK.replace('f.t', 'p')} AS phone, {_EMAIL_OK.replace('f.t', 'e')} AS email, {_LOCATION_OK.replace('f.t', 'l')} AS location FROM (SELECT doc_id, {_NUMBER} AS p, {_ADDRESS} AS e, {_PLACE} AS l FROM documents)")
def validity_of_spans(spark, sf_dir):
    as_spark = lambda sql: F.expr(sql.replace("VARCHAR", "STRING").replace("INTEGER", "INT").replace("substr('abc', 1,", "substring('abc', 1,"))
    d = mail.table(spark, sf_dir, "documents").select("doc_id", as_spark(_NUMBER).alias("p"), as_spark(_ADDRESS).alias("e"), as_spark(_PLACE).alias("l"))
    return d.select("doc_id", pii.phone_ok(F.col("p")).alias("phone"), pii.email_ok(F.col("e")).alias("email"), pii.location_ok(F.col("l")).alias("location"))


@_query(f"SELECT doc_id, n, chars, CAST({_BYTES('substring(text, 1, chars)')} AS BIGINT) AS bytes FROM (SELECT doc_id, text, doc_id % 300 AS n, CAST(len(list_filter(range(1, least(length(text), 300) + 1), lambda k: {_BYTES('substring(text, 1, k)')} <= doc_id % 300)) AS BIGINT) AS chars FROM documents)")
def byte_boundaries(spark, sf_dir):
    d = mail.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 300).alias("n"))
    chars = X.chars_within(F.col("text"), F.col("n"))
    return d.select("doc_id", "n", chars.alias("chars"), pii.byte_offset(F.col("text"), chars.cast("int")).alias("bytes"))


@_query("SELECT s_suppkey, 'email_' || lpad(CAST(s_suppkey - (SELECT min(s_suppkey) FROM supplier) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') || '.json' AS filename, s_name AS subject FROM supplier WHERE s_suppkey % 10 <> 3")
def message_files(spark, sf_dir):
    """Suppliers as message files, written with a manifest and read back in its order; every tenth has failed and leaves a gap."""
    s = mail.table(spark, sf_dir, "supplier").select(F.format_string("%09d", "s_suppkey").alias("id"), F.col("s_name").alias("subject"), *[F.lit(None).cast("string").alias(c) for c in ("snippet", "from")], F.lit(None).cast("array<string>").alias("to"), F.lit(None).cast("string").alias("sent"), F.lit(None).cast("string").alias("body"), F.when(F.col("s_suppkey") % 10 == 3, "down").alias("error"))
    at = f"{store.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    mailbox.register(spark)
    mail.write_json(s, at)
    back = mail.read_json(spark, f"{at}/email_*.json", mail.read_manifest(spark, at))
    return back.select(F.col("id").cast("long").alias("s_suppkey"), "filename", "subject")


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'Reference' ELSE 'Noise' END AS category, 'later' AS recorded_at FROM labels")
def recordings_kept(spark, sf_dir):
    """Answers recorded twice, written as files and read back: the last one stands."""
    r = mail.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("s").alias("subject"), F.lit(None).cast("string").alias("snippet"), F.lit("f").alias("from"), F.when(F.col("quality") == 1, "Reference").otherwise("Noise").alias("category"), F.lit(1.0).alias("score"), F.lit("r").alias("response"), F.lit("later").alias("recorded_at"))
    at = f"{store.shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    mail.write_recordings(r.unionByName(r.withColumns({"category": F.lit("Spam"), "recorded_at": F.lit("earlier")})), at, "model", "now")
    return mail.read_recordings(spark, at).select("id", "category", "recorded_at")


def _first_word(prompts: list[str]) -> list[str]:
    """Stands in for a model that takes the first word of a text for a name."""
    return [json.dumps([(p.split("\n---\n", 1)[1].split() or [""])[0]]) if "name" in p.split("\n", 1)[0] else "[]" for p in prompts]


_NO_HTML = "NOT contains(text, '<') AND NOT contains(text, '&')"


@_query(f"SELECT doc_id, w AS name, CAST(least(1000, len(string_split(text, w)) - 1) AS BIGINT) AS n FROM (SELECT doc_id, text, {_sql_words('text')}[1] AS w FROM documents WHERE {_NO_HTML}) WHERE regexp_full_match(w, '[A-Za-z]{{4,}}')")
def model_names(spark, sf_dir):
    docs = mail.table(spark, sf_dir, "documents").select("doc_id", "text").filter(_NO_HTML)
    docs = docs.filter(F.get(X.words(F.col("text")), 0).rlike("^[A-Za-z]{4,}$"))
    found = names.detect_all(docs, _first_word, patterns=False).select("doc_id", F.explode("entities").alias("e"))
    return found.groupBy("doc_id", F.col("e.text").alias("name")).agg(F.count("*").alias("n"))


# --- the functions of SQL ---
@_query(f"WITH {cases.SQL} SELECT id, category, CAST(score AS DOUBLE) AS score, router_urgent AS urgent FROM m WHERE body IS NULL")
def sql_rules(spark, sf_dir):
    registered.register(spark)
    f = classify.features(cases.messages(spark, sf_dir).filter("body IS NULL"))
    return spark.sql("SELECT id, rule_category(_f.c, _f.d, _f.raw, _f.sub) AS category, rule_score(_f.c, _f.d, _f.raw, _f.sub) AS score, is_urgent(subject, snippet, body) AS urgent FROM {f}", f=f)


@_query(f"SELECT doc_id, array_to_string(list_slice(list_filter({_sql_words('text')}, lambda w: NOT {_sql_noise('w')}), 1, 20), ' ') AS words, lower(split_part(source || '@' || lang || '.example.com', '@', 2)) AS domain FROM documents")
def sql_words(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT doc_id, meaningful_words(text, 20) AS words, rule_domain(concat(source, '@', lang, '.example.com')) AS domain FROM {d}", d=mail.table(spark, sf_dir, "documents"))


@_query(f"WITH {_sql_spans('documents', 'doc_id')}, {_EXPLODED}, {_sql_dictionary('x', '(doc_id, z.s)')} SELECT text, stand_in FROM d")
def sql_stand_ins(spark, sf_dir):
    registered.register(spark)
    return spark.sql("SELECT text, stand_in(pii_type, text, seed) AS stand_in FROM {m}", m=pii.mapping(_detected(spark, sf_dir), "doc_id"))


@_query(f"SELECT doc_id, z.t AS found, CAST(z.s AS BIGINT) AS start, CAST(z.s + length(z.t) AS BIGINT) AS stop FROM (SELECT doc_id, unnest({_sql_places('text', pii.EMAIL[3], 'email')}) AS z FROM documents WHERE contains(text, '@'))")
def sql_spans(spark, sf_dir):
    registered.register(spark)
    pattern = pii.EMAIL[3].replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT doc_id, s.* FROM {{d}} d, LATERAL spans_of(d.text, r'(?U){pattern}') s", d=mail.table(spark, sf_dir, "documents").filter(F.col("text").contains("@")).select("doc_id", "text"))


_WARNED = {"email": f"len(list_filter(regexp_extract_all(text, '{pii.REAL_EMAIL}'), lambda e: NOT contains(e, 'example.com') AND NOT (contains(e, 'user') AND length(e) - length(replace(e, '@', '')) = 1) AND NOT regexp_matches(e, '^user[0-9]'))) > 0", "phone": f"len(list_filter(regexp_extract_all(text, '{pii.REAL_PHONE}'), lambda p: NOT contains(p, '555'))) > 0", "name": "(" + " OR ".join(f"(contains(text, '{n}') AND list_contains({_TRIMMED}, '{n.lower()}'))" for n in pii.FIRST_NAMES) + ")"}


@_query(f"WITH {_MAIL}, first AS (SELECT id FROM m ORDER BY id LIMIT 200), f AS (SELECT id, unnest(['subject', 'from', 'body', 'snippet']) AS field, unnest([subject, sender, body || CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN ' Emily wrote' WHEN 1 THEN ' mail me@corp.io' WHEN 2 THEN ' call 415-222-3333' ELSE '' END, snippet]) AS text FROM m WHERE id IN (SELECT id FROM first)) " + " UNION ALL ".join(f"SELECT id, field, '{k}' AS warning FROM f WHERE {c}" for k, c in _WARNED.items()))
def spot_check_fields(spark, sf_dir):
    k = F.col("id").cast("long") % 4
    said = F.when(k == 0, " Emily wrote").when(k == 1, " mail me@corp.io").when(k == 2, " call 415-222-3333").otherwise("")
    return pii.spot_check(mail.messages(spark, sf_dir).withColumn("body", F.concat("body", said)), 200)


@_query(f"WITH {cases.SQL}, j AS (SELECT category, CASE WHEN CAST(id AS BIGINT) % 9 = 4 THEN 'ActionRequired' ELSE category END AS truth FROM m), g AS (SELECT count(*) FILTER (truth = 'ActionRequired' AND category = truth) * 1.0 / count(*) FILTER (truth = 'ActionRequired') AS recall, count(*) FILTER (category = 'Spam' AND truth <> 'Spam') AS false_spam FROM j) SELECT CAST(round(recall, 9) AS DOUBLE) AS recall, false_spam, recall >= 0.75 AND false_spam <= 0 AS passed FROM g")
def quality_gates(spark, sf_dir):
    j = classify.by_rules(cases.messages(spark, sf_dir)).select("category", F.when(F.col("id").cast("long") % 9 == 4, "ActionRequired").otherwise(F.col("category")).alias("truth"))
    return analysis.gates(j).withColumn("recall", F.round("recall", 9))


@_query(f"WITH {cases.SQL} SELECT category, 'Category: ' || category || ' (score: ' || printf('%.2f', score) || ')' AS shown, count(*) AS n FROM m GROUP BY category, score")
def result_texts(spark, sf_dir):
    c = classify.by_rules(cases.messages(spark, sf_dir)).select("category", classify.result_text(F.col("category"), F.col("score")).alias("shown"))
    return c.groupBy("category", "shown").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
