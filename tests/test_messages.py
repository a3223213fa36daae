import pytest
from pyspark.sql import functions as F

from lettermill.functions import text as X
from lettermill.operators import classify, route
from lettermill.sources import mail


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, cleaned",
    [("Visit https://a.example/x now", "Visit [URL] now"), ("mail me@site.example please", "mail [EMAIL] please"), ("A &amp; B", "A B"), ("call (555) 123-4567", "call (555) 123-4567"), ("Hello​world", "Hello world"), ("", ""), (None, None)],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, raw, X.clean) == cleaned


def test_words_and_domains(spark):
    assert one(spark, "click here to view our 12 plans [URL] a", lambda c: X.meaningful(c, 10)) == "to our plans [URL]"
    assert one(spark, "A B <a@x@Y.Example>", X.rule_domain) == "x"
    assert one(spark, "A B <a@x@Y.Example>", X.domain) == "y.example"
    assert one(spark, "nobody", X.domain) is None


def test_html():
    assert X.read_html("<p>Hi <b>you</b></p><script>x()</script><a href='http://l.example'>go</a>") == "Hi you\ngo\n[1]: http://l.example"


def test_html_in_columns_is_the_parsers(spark):
    cases = ["<p>Hi <b>you</b></p><script>x()</script><a href='http://l.example'>go</a>", "a &amp; b &lt;c&gt; &#233;&#x20AC;&#128512; &nope; &copy;", "<!-- x > y --><DIV>A<br/>B</DIV>C", "<style>p{}</style>x  y\tz", "<a class='q' href=\"/x?a=1&amp;b=2\">l</a> 1 < 2", None, "", "no tags", "<ul><li>a</li><li>b</li></ul>", "<A HREF=x>u</A><a name=n>v</a>"]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, h string")
    assert {r.k: r.t for r in df.select("k", X.html_text(F.col("h")).alias("t")).collect()} == {k: X.read_html(c) for k, c in enumerate(cases)}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", X.html_text(F.col("html")).alias("t")).collect():
        assert r.t == X.read_html(r.html)


def test_demo_messages_take_the_branches(spark):
    got = {r.id: (r.category, r.score) for r in classify.by_rules(mail.demo(spark)).collect()}
    assert got == {"1": ("Reference", 0.8), "2": ("ActionRequired", 0.9), "3": ("InterestingInfo", 0.85), "4": ("Spam", 0.95), "5": ("Reference", 0.6)}


def test_hybrid_sends_only_the_rest_to_the_model(spark):
    asked = []

    def model(df):
        asked.append(df.count())
        return df.withColumns({"category": F.lit("Spam"), "score": F.lit(0.9), "response": F.lit("m"), "error": F.when(F.col("id") == "5", F.lit("down"))})

    got = {r.id: r.category for r in classify.hybrid(mail.demo(spark), model).collect()}
    assert asked == [3] and got["2"] == "ActionRequired" and got["4"] == "Spam" and got["5"] == "Reference"


def test_route_and_decide(spark):
    r = {x.id: x for x in route.decided(route.route(classify.by_rules(mail.demo(spark)))).collect()}
    assert [a.kind for a in r["2"].actions] == ["MarkImportant", "Escalate", "Label"] and not r["2"].archived
    assert [a.target for a in r["5"].actions] == ["Agentic/Needs Review"] and r["5"].stay_in_inbox and r["5"].archived


def test_reply_and_replay(spark):
    assert one(spark, 'ok {"category": "Noise", "score": 0.4, "explanation": "e"}!', classify.parse_reply)["category"] == "Noise"
    assert one(spark, '{"category": "Noise", "score": 4, "explanation": "e"}', classify.parse_reply) is None
    m = mail.demo(spark)
    rec = m.filter("id = '1'").select("id", "subject", "snippet", "from", F.lit("Noise").alias("category"), F.lit(0.1).alias("score"), F.lit("r").alias("response"), F.lit("a").alias("recorded_at"))
    assert {x.id: x.error is None for x in classify.replay(m, rec).collect()} == {"1": True, "2": False, "3": False, "4": False, "5": False}


def test_labels(spark):
    m = spark.createDataFrame([("1", ["INBOX"]), ("2", None)], "id string, label_ids array<string>")
    dim = spark.createDataFrame([("INBOX", "INBOX")], "id string, name string")
    w = spark.createDataFrame([("1", "Agentic/Work"), ("1", "Agentic/Work")], "message_id string, label string")
    new, labels = route.apply_labels(m, dim, w)
    assert {r.id: r.label_ids for r in new.collect()} == {"1": ["INBOX", "label_agentic/work"], "2": []}
    left, kept = route.drop_labels(new, labels, route.own_label(F.col("name")))
    assert kept.count() == 1 and {r.id: r.label_ids for r in left.collect()} == {"1": ["INBOX"], "2": []}


def test_entry_imports():
    import __spark_entry__

    assert "category_counts" in __spark_entry__.queries() and "category_counts" in __spark_entry__.oracle_sql()
