"""Spans, stand-ins, the model stage and anonymised sets, against plain Python and literal cases."""

import random
import time

import plain_pii
import pytest
from pyspark.sql import functions as F

from lettermill.operators import model, names, pii, spans, standins
from lettermill.sources import mail

CASES = ["555-123-4567 ext 12", "(415) 555-0100", "123-45-6789", "a.b@c.example", "x [at] y [dot] example", "D-10115", "nothing", "", "I live in 8700 Küsnacht, Switzerland.", "Visit me at Weinmanngasse 15 tomorrow.", "Meeting in Zürich next week.", "Shipping to 10115 Berlin, Germany.", "from St. Gallen to Yverdon-les-Bains", "10115 Bern and Bernese", "Please call me at 555-123-4567 for more information.", "Contact: 555.123.4567", "Phone: 5551234567", "International: +1-555-123-4567", "Call 555-123-4567 or (555) 987-6543 for support.", "Invalid numbers: 123-45-6789 (SSN), 12345 (too short), 123-456-78901 (too long)", '<div>Contact us at <a href="tel:555-123-4567">555-123-4567</a></div>', "Office: 555-123-4567 ext 1234", "Swiss number: +41 79 706 7378", "Bahnhofstrasse 12345, Bahnhofstrasse 1234, Bahnhofstrasse 1234a", "0123 Bergmann Hof x 01067 Dresden 00123 Abc A-0123 A-1010", 'é5551234567 "a@b.co" <x@y.zw> a@b..c @ a@ é@x.de mé@x.de', "(at) x(at)y(dot)example  j [at] k [dot] li", "+41 79 706 7378 +41797067378 1 555 123 4567", "🙂 +1-555-123-4567 🙂 a@b.example 🙂 Zug", "８７００ 5551234567５", "Köniz Biel/Bienne La Chaux-de-Fonds\nZürichberg 7b"]


def as_spans(rows):
    return [(s.pii_type, s.text, s.start, s.end) for s in rows]


def test_columns_are_the_plain_form(spark):
    r = random.Random(2)
    parts = [x for c in CASES for x in c.split(" ")] + ["\n", "ext", "5", "@", "+", "-", "mann 3"]
    texts = CASES + ["".join(r.choice(parts) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(2, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = F.col("text")
    got = {x.id: x for x in pii.detect(df.withColumns({"raw": pii.pattern_spans(t)})).collect()}
    for k, text in enumerate(texts):
        assert as_spans(got[k].raw) == plain_pii.pattern_spans(text), text
        assert as_spans(got[k].entities) == plain_pii.detect_text(text), text


def test_columns_are_the_plain_form_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for x in pii.detect(df).collect():
        assert as_spans(x.entities) == plain_pii.detect_text(x.text or "")


@pytest.mark.parametrize(
    "text, found",
    [("555-123-4567 ext 12", [("phone", "555-123-4567 ext 12")]), ("123-45-6789 123-456-78901", []), ("x [at] y [dot] example", [("email", "x [at] y [dot] example")]), ("D-10115 A-1010", [("location", "D-10115")]), ("8700 Küsnacht", [("location", "Küsnacht")]), ("Bahnhofstrasse 12345", [("location", "Bahnhofstrasse 12345")]), ("Bahnhofstrasse 1234", []), ("Bahnhofstrasse 1234a", [("location", "Bahnhofstrasse 1234a")]), ("Shipping to 10115 Berlin", [("location", "10115 Berlin")])],
)
def test_literal_cases(spark, text, found):
    assert [(s.pii_type, s.text) for s in pii.detect(spark.createDataFrame([(text,)], "text string")).first().entities] == found


def test_overlaps_are_settled_in_turn(spark):
    r = random.Random(5)
    for trial in range(6):
        found = []
        for _ in range(r.choice([0, 1, 2, 40, 200])):
            a = r.randint(0, 300)
            found.append((r.choice(["name", "phone", "email"]), "x" * r.randint(1, 9), a, a + r.randint(1, 9)))
        df = spark.createDataFrame([(found,)], f"f array<{spans.SPAN}>")
        row = df.select(spans.settled(F.col("f")).alias("m"), pii.resolved(F.col("f")).alias("r")).first()
        # spans of one start keep the order of their turns, which the plain form doesn't promise after it swaps
        assert sorted(as_spans(row.m)) == sorted(plain_pii.merged(found)) and [s.start for s in row.m] == sorted(s.start for s in row.m)
        assert sorted(as_spans(row.r)) == sorted(plain_pii.resolved(found)), trial


def test_a_text_of_many_spans_takes_no_square(spark):
    text = "a@b.example " * 3000
    began = time.time()
    row = pii.detect(spark.createDataFrame([(text,)], "text string")).first()
    assert len(row.entities) == 3000 and row.entities[2999].end == len(text) - 1 and time.time() - began < 60


# --- overlaps across rows ---
def random_spans(r, n, docs, longest):
    return [(r.randrange(docs), a, a + r.randint(0, longest)) for a in (r.randrange(500) for _ in range(n))]


def test_interval_join_and_groups(spark):
    r = random.Random(3)
    left, right = random_spans(r, 300, 3, 200), random_spans(r, 300, 3, 5)
    schema = "doc int, start long, end long"
    a, b = (spark.createDataFrame([*x, (None, 1, 5)], schema) for x in (left, right))
    got = sorted(map(tuple, spans.overlapping(a, b, ["doc"], 16).select("doc", "start", "end", "start2", "end2").collect()))
    assert got == sorted((d, s, e, s2, e2) for d, s, e in left for d2, s2, e2 in right if d == d2 and s < e2 and s2 < e)
    groups = spans.overlap_groups(b.filter("doc IS NOT NULL AND end > start"), ["doc"]).collect()
    for d in range(3):
        rows = sorted((x.start, x.end, x.group) for x in groups if x.doc == d)
        reach, n = -1, 0
        for s, e, g in sorted(rows, key=lambda x: (x[0], -x[1])):
            n += s >= reach
            reach = max(reach, e)
            assert g == n
    assert spans.overlapping(a.limit(0), b, ["doc"]).count() == 0


# --- stand-ins ---
def test_replacement_is_consistent(spark):
    d = spark.createDataFrame([(1, "to a@b.example and c@d.example"), (2, "again a@b.example."), (3, "none"), (4, None)], "doc_id long, text string")
    done = pii.replaced(pii.detect(d), "doc_id")
    got = {r.doc_id: r.text for r in done.collect()}
    assert got == {1: "to user1@example.com and team2@sample.net", 2: "again user1@example.com.", 3: "none", 4: None}
    assert standins.replacement_rate(done, {"text": "entities"}).first()[:] == (3, 3, 100)
    log = [tuple(x) for r in done.filter("doc_id = 1").collect() for x in r.replacements]
    assert log == [("text", "email", "a@b.example", "user1@example.com", 3), ("text", "email", "c@d.example", "team2@sample.net", 25)]


def test_every_row_is_replaced_whatever_its_key(spark):
    d = spark.createDataFrame([(None, "to a@b.example"), (1, "first c@d.example"), (1, "second e@f.example."), (2, "none")], "id long, text string")
    got = [r.text for r in pii.replaced(pii.detect(d), "id").collect()]
    assert len(got) == 4 and "none" in got and not any("b.example" in t or "d.example" in t or "f.example" in t for t in got)
    assert sum(t.startswith("second ") and t.endswith(".") for t in got) == 1


def test_a_span_is_left_where_something_else_stands(spark):
    wrong = [("name", "John", 0, 4), ("name", "Ann Lee", 9, 12), ("name", "x", 10, 11)]
    d = spark.createDataFrame([(1, "Jane and Ann", wrong)], f"id long, text string, entities array<{spans.SPAN}>")
    done = pii.replaced(d, "id")
    assert done.first().text == "Jane and Cameron Garcia" and standins.replacement_rate(done, {"text": "entities"}).first()[:] == (3, 1, 33)


def test_a_dictionary_goes_on_in_the_next_run(spark, tmp_path):
    at = f"{tmp_path}/dictionary"
    one = spark.createDataFrame([(1, "a@b.example c@d.example")], "id long, text string")
    two = spark.createDataFrame([(1, "new@b.example"), (2, "c@d.example, 555-123-4567")], "id long, text string")
    first = pii.replaced(pii.detect(one), "id", dictionary=at).first().text.split()
    second = {r.id: r.text for r in pii.replaced(pii.detect(two), "id", dictionary=at).collect()}
    assert second[2].startswith(first[1] + ", ") and second[1] not in first
    table = {r.text: r.seed for r in standins.kept(spark, at).collect()}
    assert table == {"a@b.example": 0, "c@d.example": 1, "new@b.example": 2, "555-123-4567": 3}
    again = {r.id: r.text for r in pii.replaced(pii.detect(two), "id", dictionary=at).collect()}
    assert again == second and standins.kept(spark, at).count() == 4


# --- the model stage ---
def counted(at):
    """A model that notes each prompt it is asked; prompts with `boom` raise, `slow` ones take too long."""

    def ask(prompts):
        import uuid

        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        if any("boom" in p for p in prompts):
            raise OSError("down")
        if any("slow" in p for p in prompts):
            time.sleep(3)
        return [p.upper() for p in prompts]

    return ask


def asked(at):
    return sorted(line for f in at.iterdir() for line in f.read_text().split("\n"))


def test_prompts_are_asked_once_and_fail_alone(spark, tmp_path):
    calls, kept = tmp_path / "calls", f"{tmp_path}/replies"
    calls.mkdir()
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "a", "b", "boom", None, "a", "slow"])], "id int, prompt string").repartition(4)
    got = {r.id: (r.reply, r.error) for r in model.answered(rows, counted(calls), kept, call=1, seconds=1).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "A", 1: "A", 2: "B", 3: None, 4: None, 5: "A", 6: None}
    assert got[3][1] == "OSError: down" and got[6][1].startswith("TimeoutError: no reply within 1") and got[0][1] is None and got[4][1] is None
    assert asked(calls) == ["a", "b", "boom", "slow"]
    # the next run asks what failed and what is new
    more = spark.createDataFrame([(1, "a"), (2, "c"), (3, "boom")], "id int, prompt string")
    got = {r.id: r.reply for r in model.answered(more, counted(calls), kept, call=4).collect()}
    assert got == {1: "A", 2: "C", 3: None}
    assert asked(calls).count("a") == 1 and asked(calls).count("c") <= 2


def test_one_failed_prompt_of_a_call_costs_one_row(spark, tmp_path):
    rows = spark.createDataFrame([(k, "boom" if k == 17 else f"p{k}") for k in range(50)], "id int, prompt string").coalesce(1)
    got = model.answered(rows, counted(tmp_path), call=16).collect()
    assert [r.id for r in got if r.error] == [17] and sum(r.reply is not None for r in got) == 49


def test_prompts_hold_the_first_words():
    assert names.prepare("Ship to Weinmanngasse 15 / 8700 Küsnacht, Privacy Ltd, view", 100) == "Ship to Weinmanngasse 15 / 8700 Küsnacht, Privacy Ltd, view"
    assert names.prepare("a b c d", 3) == "a b c" and names.prepare("<p>x</p>\n\n<b>y</b> 1", 50) == "x y 1"


def finds_ann():
    return lambda prompts: ["oops" if "boom" in p else "[]" if "address" in p else '["Ann Lee"]' for p in prompts]


def test_names_and_patterns_together(spark):
    d = spark.createDataFrame([(1, "Ann Lee, a@b.example"), (2, "boom"), (3, None)], "id long, text string")
    got = {r.id: ([(e.pii_type, e.text) for e in r.entities], r.error is None) for r in names.detect_all(d, finds_ann()).collect()}
    assert got == {1: ([("name", "Ann Lee"), ("email", "a@b.example")], True), 2: ([], False), 3: ([], True)}
    alone = {r.id: [e.text for e in r.entities] for r in names.detect_all(d, finds_ann(), patterns=False).collect()}
    assert alone[1] == ["Ann Lee"]


def test_a_set_is_anonymised_whole(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    note, find = counted(calls), finds_ann()

    def ask(prompts):
        note(prompts)
        return find(prompts)

    rows = [mail.message("1", "Ann Lee e@f.example", "none", body="c@d.example"), mail.message("1", "e@f.example", "none", body="Ann Lee"), mail.message("2", "plain", body="c@d.example"), mail.message("9")]
    m = spark.createDataFrame(rows, mail.MESSAGE)
    m = m.unionByName(m.limit(1).withColumns({"id": F.lit(None).cast("string"), "subject": F.lit("c@d.example")}))
    done, errors = names.anonymised(m, ask)
    got = done.collect()
    assert len(got) == 5 and errors.count() == 0 and sorted(str(r.id) for r in got) == ["1", "1", "2", "9", "None"]
    spoken = {}
    for r in got:
        for x in r.replacements:
            assert spoken.setdefault(x.original, x.stand_in) == x.stand_in
    assert set(spoken) == {"Ann Lee", "e@f.example", "c@d.example"} and len(set(spoken.values())) == 3
    assert not any("Ann" in (t or "") or ".example" in (t or "") for r in got for t in (r.subject, r.snippet, r.body))
    # each distinct text is asked about twice, whatever reads the result
    done.count(), errors.count()
    texts = {t for r in m.collect() for t in (r.subject, r.snippet, r.body) if t}
    assert len([p for p in asked(calls) if p.startswith("List every")]) == 2 * len(texts)
    assert names.summary(m, done).first().asDict() == {"total": 5, "processed": 5, "replaced": 8, "errors": 0}


def test_a_row_that_fails_is_named_whole(spark):
    m = spark.createDataFrame([mail.message("1", "Ann Lee", "none", body="a@b.example"), mail.message("2", "boom", "kept")], mail.MESSAGE)
    done, errors = names.anonymised(m, finds_ann())
    assert [r.id for r in done.collect()] == ["1"]
    assert [(r.row.id, r.row.snippet, r.column) for r in errors.collect()] == [("2", "kept", "subject")]
    assert names.summary(m, done).first().errors == 1
    empty, none = names.anonymised(m.limit(0), finds_ann())
    assert empty.count() == 0 == none.count()
