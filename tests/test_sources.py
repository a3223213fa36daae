"""The mailbox source in batch and as a stream, message files, recordings."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lettermill.operators import classify
from lettermill.sources import mail, mailbox, mime


def lines(n):
    """n messages, every third unread, every tenth broken."""
    for k in range(n):
        whole = json.dumps({"id": f"m{k}", "labelIds": ["INBOX", *(["UNREAD"] if k % 3 == 0 else [])], "snippet": "é" * (k % 7), "payload": {"headers": [{"name": "Subject", "value": f"s{k}"}], "body": {"data": "x" * (k * 13 % 400)}}}, ensure_ascii=False)
        yield whole[: len(whole) // 2] if k % 10 == 7 else whole


def box(at, files, name="part"):
    at.mkdir(exist_ok=True)
    for k, part in enumerate(files):
        (at / f"{name}-{k}.jsonl").write_text("\n".join(part) + ("\n" if k % 2 else ""))
    (at / "_SUCCESS").write_text("")
    return str(at)


@pytest.fixture(scope="module")
def formats(spark):
    mailbox.register(spark)


def test_ranges_cut_no_line(spark, formats, tmp_path):
    every = list(lines(300))
    at = box(tmp_path / "box", [every[:120], every[120:121], [], every[121:]])
    for size in (50, 997, 1 << 20):
        rows = spark.read.format("mailbox").option("partBytes", size).load(at).collect()
        assert sorted(r.id for r in rows) == sorted(f"m{k}" for k in range(300))
        assert {r.id for r in rows if r.error} == {f"m{k}" for k in range(300) if k % 10 == 7} and all(r.raw is None for r in rows if r.error)
    assert spark.read.format("mailbox").load(str(tmp_path / "nowhere")).count() == 0


def test_the_filter_reaches_the_reader(spark, formats, tmp_path):
    at = box(tmp_path / "box", [list(lines(100))])
    df = spark.read.format("mailbox").load(at)
    read = df.filter("unread = true AND id > 'm5'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "unread" not in plan.split("Filter", 1)[1].split("\n")[0]
    want = {f"m{k}" for k in range(100) if k % 3 == 0 or k % 10 == 7}
    assert {r.id for r in read.collect()} == {x for x in want if x > "m5"}
    assert {r.id for r in df.filter("unread = false").collect()} == {f"m{k}" for k in range(100)} - want
    assert df.filter("unread = true AND unread = false").count() == 0
    assert [r.id for r in mailbox.unread(spark, at).collect()] == sorted(want)[:5] and mailbox.inbox(spark, at, 500).count() == 100
    parsed = {r.id: r for r in mime.parse_messages(mailbox.unread(spark, at, None).filter("error IS NULL")).collect()}
    assert parsed["m3"].subject == "s3" and parsed["m3"].body == "x" * 39


def test_stream_and_batch_read_the_same(spark, formats, tmp_path):
    every = list(lines(60))
    at = box(tmp_path / "box", [every[:20], every[20:30]])

    def run():
        q = spark.readStream.format("mailbox").option("partBytes", 300).load(at).filter("unread = true").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)

    seen = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = lambda: sorted(r.id for r in spark.read.format("mailbox").load(at).filter("unread = true").collect())
    run()
    first = seen()
    assert first == batch()
    box(tmp_path / "box", [every[30:]], "later")
    run()
    assert seen() == batch() and len(seen()) > len(first)


def test_message_files_have_a_manifest_and_an_order(spark, formats, tmp_path):
    rows = [mail.message(f"k{k:03d}", f"s{k} é" if k % 4 else None, body="b" if k % 3 else None) for k in range(40)]
    m = spark.createDataFrame(rows, mail.MESSAGE).withColumn("error", F.when(F.col("id") == "k007", "down")).repartition(5)
    at = str(tmp_path / "set")
    mail.write_json(m, at, created_at="now")
    names = sorted(p.name for p in (tmp_path / "set").glob("email_*.json"))
    assert len(names) == 39 and "email_008.json" not in names and names[0] == "email_001.json"
    assert json.loads((tmp_path / "set/email_002.json").read_text()) == {"id": "k001", "subject": "s1 é", "snippet": None, "from": None, "to": None, "sent": None, "body": "b", "file_index": 2}
    head = json.loads((tmp_path / "set/manifest.json").read_text())
    assert (head["created_at"], head["total_emails"], head["errors"]) == ("now", 39, 1)
    entries = mail.read_manifest(spark, at)
    flags = {r.id: (r.file_index, r.filename, r.subject, r.has_body) for r in entries.collect()}
    assert flags["k003"] == (4, "email_004.json", "s3 é", False) and len(flags) == 39
    back = mail.read_json(spark, f"{at}/email_*.json", entries).collect()
    assert [r.id for r in back] == [f"k{k:03d}" for k in range(40) if k != 7]
    failed = [json.loads(x) for p in (tmp_path / "set/errors").iterdir() for x in p.read_text().splitlines()]
    assert failed == [{"file_index": 8, "id": "k007", "error": "down"}]
    # a set that is there is not written over
    with pytest.raises(PySparkException):
        mail.write_json(m, at)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("set")] == ["set"]
    (tmp_path / "list").mkdir()
    (tmp_path / "list/manifest.json").write_text(json.dumps({"emails": [{"file_index": 2, "filename": "email_003.json"}, {"file_index": 1, "filename": "email_005.json"}, {"file_index": 3, "filename": "gone.json"}]}, indent=1))
    assert [r.id for r in mail.read_json(spark, f"{at}/email_*.json", mail.read_manifest(spark, str(tmp_path / "list"))).collect()] == ["k004", "k002"]


def test_an_aborted_run_leaves_nothing(spark, formats, tmp_path):
    m = spark.createDataFrame([mail.message(f"k{k}", "s") for k in range(20)], mail.MESSAGE)
    broken = mail.named(m).withColumn("subject", F.when(F.col("file_index") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("subject")))
    with pytest.raises(PySparkException):
        broken.repartition(4).write.format("message_files").mode("append").save(str(tmp_path / "set"))
    assert not list(tmp_path.glob("set*"))


def test_files_that_are_no_json_are_passed_over(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"subject": "x"}')
    (tmp_path / "b.json").write_text('{"id": "2", ')
    assert [(r.id, r.subject) for r in mail.read_json(spark, f"{tmp_path}/*.json").collect()] == [("unknown", "x")]
    assert mail.count_json(spark, str(tmp_path)) == 2


def test_recordings_keep_the_last(spark, tmp_path):
    schema = "id string, subject string, snippet string, `from` string, category string, score double, response string, recorded_at string"
    rows = spark.createDataFrame([("1", None, None, None, "Noise", 0.5, "a", None), ("1", "", "", "", "Spam", 0.6, "b", None), ("2", "s", None, None, "Noise", 0.5, "a", "1"), ("2", "s", "", None, "Spam", 0.5, "b", "2"), ("2", "s", "", None, "Reference", 0.5, "c", None)], schema)
    last = {r.id: r for r in mail.keep_last(rows).collect()}
    assert len(last) == 2 and last["1"].category == "Spam" and (last["2"].category, last["2"].recorded_at) == ("Spam", "2")
    mail.write_recordings(rows, f"{tmp_path}/rec", "m", "now", per_file=1)
    back = mail.read_recordings(spark, f"{tmp_path}/rec")
    assert {(r.id, r.category, r.response) for r in back.collect()} == {("1", "Spam", "b"), ("2", "Spam", "b")}
    m = spark.createDataFrame([mail.message("1"), mail.message("2", "s"), mail.message("3")], mail.MESSAGE)
    assert {r.id: (r.category, r.error is None) for r in classify.replay(m, back).collect()} == {"1": ("Spam", True), "2": ("Spam", True), "3": (None, False)}
    new = mail.record(back, classify.fixed(m.filter("id = '1'"), "Reference", 1.0).withColumn("response", F.lit("r")), "3")
    assert {r.id: r.category for r in new.collect()} == {"1": "Reference", "2": "Spam"}
