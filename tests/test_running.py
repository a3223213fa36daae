"""Known originals, observed counters, streams against batch."""

import random

from pyspark.sql import functions as F

from lettermill.operators import classify, known, pii, progress, route, standins
from lettermill.sources import mail
from lettermill.streaming import recordings, wrap


def test_every_place_of_every_known_text(spark):
    r = random.Random(6)
    words = [("aba", "name"), ("ab", "name"), ("b", "email"), ("é𝄞", "phone"), ("a", "name"), ("zzz", "x"), ("ab", "address"), ("", "y"), (None, "z")]
    texts = ["".join(r.choices("abé𝄞 ", k=r.randint(0, 80))) for _ in range(60)] + [None, "", "a" * 30_000]
    df = spark.createDataFrame([(k % 50, t, "q") for k, t in enumerate(texts)], "id int, text string, pii_type string").repartition(3)
    table = spark.createDataFrame(words, "text string, pii_type string")
    kinds = {"aba": "name", "ab": "address", "b": "email", "é𝄞": "phone", "a": "name", "zzz": "x"}
    want = sorted((k % 50, kinds[w], w, p, p + len(w)) for k, t in enumerate(texts) if t for w in kinds for p in range(len(t)) if t.startswith(w, p))
    for size in (1 << 20, 70):
        got = sorted(map(tuple, known.occurrences(df, table, "id", block_bytes=size).collect()))
        assert got == want
    assert known.occurrences(df, table.limit(0), "id").count() == 0 == known.occurrences(df.limit(0), table, "id").count()


def decided(df):
    failed = F.when(F.col("id") == "5", "down")
    return route.decided(classify.by_rules(df)).withColumn("error", failed)


def test_counters_come_with_the_work(spark, tmp_path):
    rows, watch = progress.observed(decided(mail.demo(spark)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    rows.write.parquet(f"{tmp_path}/out")
    jobs = len(tracker.getJobIdsForGroup("counted"))
    assert watch.get == {"total": 5, "kept": 1, "archived": 3, "urgent": 1, "needs_review": 0, "errors": 1}
    assert len(tracker.getJobIdsForGroup("counted")) == jobs
    spark.sparkContext.setJobGroup("", "")


def stream_of(spark, tmp_path, parts):
    for k, part in enumerate(parts):
        part.coalesce(1).write.json(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(mail.MESSAGE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def run(query):
    q = query.start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_stream_and_batch_decide_the_same(spark, tmp_path):
    m = mail.demo(spark)
    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        stream = progress.watched(decided(stream_of(spark, tmp_path, [m.filter("id < 3"), m.filter("id >= 3")])))
        run(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(50):
            if listener.total.get("total") == 5:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {r.id: (r.category, r.why, r.error) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: (r.category, r.why, r.error) for r in decided(m).collect()}
    assert {k: listener.total[k] for k in ("total", "kept", "archived", "urgent", "errors")} == {"total": 5, "kept": 1, "archived": 3, "urgent": 1, "errors": 1}
    assert len(listener.batches) >= 2


def test_wrapped_streams_go_on(spark, tmp_path):
    mail.demo(spark).filter("id < 3").write.json(f"{tmp_path}/in/a")
    detect = lambda df: pii.detect(df.select("id", F.col("subject").alias("text")))
    start = lambda: wrap.write(wrap.read(spark, f"{tmp_path}/in/*"), detect, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    start()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    mail.demo(spark).filter("id >= 3").write.json(f"{tmp_path}/in/b")
    start()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "3", "4", "5"]


def test_a_stream_of_recordings_keeps_the_last(spark, tmp_path):
    r = random.Random(1)
    schema = "id string, subject string, snippet string, `from` string, category string, score double, response string, recorded_at string"
    rows = [(str(r.randint(0, 5)), r.choice([None, "", "s"]), None, "f", r.choice(["Noise", "Spam"]), r.choice([0.5, None]), r.choice(["a", "b"]), r.choice([None, "1", "2", "3"])) for _ in range(80)]
    for k in range(3):
        spark.createDataFrame(rows[k * 27 : (k + 1) * 27], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}", ignoreNullFields=True)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    latest: dict = {}

    def keep(batch, _):
        # an update takes the place of the one before
        for x in batch.collect():
            latest[x[:4]] = x[4:]

    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        run(recordings.latest(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert latest == {x[:4]: x[4:] for x in mail.keep_last(spark.createDataFrame(rows, schema)).collect()}


def test_a_stream_replays_and_replaces_as_a_table_does(spark, tmp_path):
    m = mail.demo(spark)
    recorded = m.filter("id = '1'").select("id", "subject", "snippet", "from", F.lit("Noise").alias("category"), F.lit(0.1).alias("score"), F.lit("r").alias("response"), F.lit("a").alias("recorded_at"))
    table = spark.createDataFrame([("a@b.example", "email", 0, "x@y.example")], standins.SCHEMA)
    seen = []

    def each(batch, _):
        rows = pii.detect(classify.replay(batch, recorded).withColumn("text", F.concat(F.col("id"), F.lit(" a@b.example")))).withColumn("_n", F.monotonically_increasing_id())
        seen.extend((r.id, r.category, r.text) for r in standins.replaced(rows, {"text": "entities"}, table).collect())

    run(stream_of(spark, tmp_path, [m]).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True))
    assert sorted(seen) == [(str(k), "Noise" if k == 1 else None, f"{k} x@y.example") for k in range(1, 6)]
