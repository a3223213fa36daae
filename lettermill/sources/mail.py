"""Messages: schema, readers and writers, and the view of the sample tables as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import numbered

S = T.StringType()
MESSAGE = T.StructType([T.StructField("id", S, False), T.StructField("subject", S), T.StructField("snippet", S), T.StructField("from", S), T.StructField("to", T.ArrayType(S)), T.StructField("sent", S), T.StructField("body", S)])
DEFAULTS = {"subject": "(No Subject)", "snippet": "(No Preview)", "from": "(Unknown Sender)", "sent": "(Unknown Date)", "body": "(No Body)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages: the first line is the subject, 200 characters are the snippet."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), F.substring("text", 1, 200).alias("snippet"), F.concat("source", F.lit("@"), "lang", F.lit(".example.com")).alias("from"), F.array(F.concat(F.lit("Desk <"), "source", F.lit("@List.example.com>"))).alias("to"), F.lit(None).cast("string").alias("sent"), F.col("text").alias("body"))


def read_json(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """One message per file; files that are no JSON are skipped, a missing id is `unknown`. manifest (filename, file_index) selects files and brings file_index, which their order is."""
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in MESSAGE], T.StructField("_corrupt_record", S)])
    got = spark.read.schema(shape).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"))
    got = got.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumn("id", F.coalesce("id", F.lit("unknown")))
    if manifest is None:
        return got
    named_ = manifest.groupBy("filename").agg(F.min("file_index").alias("file_index"))
    return got.join(named_, "filename").orderBy("file_index")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_index, filename, id, subject, has_*: entries of a folder's manifest, which holds them itself or names the parts that do."""
    entry = "struct<file_index:bigint,filename:string,id:string,subject:string,has_snippet:boolean,has_from:boolean,has_to:boolean,has_sent:boolean,has_body:boolean>"
    at = path.rstrip("/")
    head = spark.read.schema(f"emails array<{entry}>, parts array<string>").option("multiLine", True).json(f"{at}/manifest.json")
    inside = head.select(F.explode("emails").alias("e")).select("e.*")
    if not head.filter("parts IS NOT NULL AND size(parts) > 0").count():
        return inside
    return inside.unionByName(spark.read.schema(inside.schema).json(f"{at}/manifest"))


def named(df: DataFrame, order: str = "id") -> DataFrame:
    """df with file_index (from 1, by `order`) and filename (email_001.json and so on)."""
    return numbered(df, [order], "file_index", 1).withColumn("filename", F.format_string("email_%03d.json", "file_index"))


def write_json(df: DataFrame, path: str, order: str = "id", created_at: str | None = None) -> None:
    """A folder of one pretty-printed file for each message, with a manifest; rows that have an `error` leave a gap and go to its errors. Needs mailbox.register()."""
    n = named(df, order).repartitionByRange("file_index").sortWithinPartitions("file_index")
    out = n.write.format("message_files").mode("append")
    (out.option("createdAt", created_at) if created_at else out).save(path)


def manifest(df: DataFrame) -> DataFrame:
    """file_index, filename, id, subject and has_* flags of each message, by id."""
    return named(df).select("file_index", "filename", "id", "subject", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("snippet", "from", "to", "sent", "body")])


def manifest_totals(df: DataFrame, created_at: str) -> DataFrame:
    """created_at, total_emails, and how many messages have each field."""
    return df.agg(F.lit(created_at).alias("created_at"), F.count("*").alias("total_emails"), *[F.count(c).alias(f"with_{c}") for c in ("snippet", "from", "to", "sent", "body")])


def count_json(spark: SparkSession, path: str) -> int:
    """Files of a folder that end in .json; folders below don't count."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path").count()


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers from JSON files {"responses": [...], "metadata": {...}}, a row for each signature: the last recorded wins."""
    answer = "struct<category:string,score:double,llm_response:string>"
    rows = spark.read.schema(f"responses array<struct<email_id:string,email_subject:string,email_snippet:string,email_from:string,classification:{answer},recorded_at:string>>").option("multiLine", True).json(path)
    flat = rows.select(F.explode("responses").alias("r")).select(F.col("r.email_id").alias("id"), F.col("r.email_subject").alias("subject"), F.col("r.email_snippet").alias("snippet"), F.col("r.email_from").alias("from"), F.col("r.classification.category").alias("category"), F.col("r.classification.score").alias("score"), F.col("r.classification.llm_response").alias("response"), F.col("r.recorded_at").alias("recorded_at"))
    return keep_last(flat)


SIGNATURE = ("id", "subject", "snippet", "from")


def keep_last(recordings: DataFrame) -> DataFrame:
    """A row for each signature (null parts count as empty): of its answers the last by time, those without a time before all others; ties by the answer itself."""
    signature = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SIGNATURE]
    answer = F.struct("recorded_at", "category", "score", "response")
    return recordings.groupBy(*signature).agg(F.max(answer).alias("a")).select(*SIGNATURE, "a.category", "a.score", "a.response", "a.recorded_at")


def write_recordings(recordings: DataFrame, path: str, model: str, recorded_at: str, per_file: int = 10_000) -> None:
    """Answers as files of {"responses": [...], "metadata": {...}} of at most per_file answers, which read_recordings reads."""
    shown = F.struct(F.col("id").alias("email_id"), F.col("subject").alias("email_subject"), F.col("snippet").alias("email_snippet"), F.col("from").alias("email_from"), F.struct("category", "score", F.col("response").alias("llm_response")).alias("classification"), F.col("response").alias("raw_response"), "recorded_at")
    placed = numbered(keep_last(recordings), list(SIGNATURE), "_n").select(F.floor(F.col("_n") / per_file).alias("_file"), "_n", shown.alias("r"))
    whole = placed.groupBy("_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "r"))), lambda x: x["r"]).alias("responses"))
    metadata = F.struct(F.lit(model).alias("model"), F.lit(recorded_at).alias("recorded_at"), F.size("responses").cast("long").alias("total_responses"))
    whole.select("responses", metadata.alias("metadata")).write.option("maxRecordsPerFile", 1).json(path)


def record(recordings: DataFrame, classified: DataFrame, recorded_at: str) -> DataFrame:
    """recordings with the answers of classified messages added; an answer to a known signature takes the old one's place."""
    new = classified.select("id", "subject", "snippet", "from", "category", "score", "response", F.lit(recorded_at).alias("recorded_at"))
    return keep_last(recordings.unionByName(new))


def stub(spark: SparkSession, rows: list[tuple], error: str | None = None) -> DataFrame:
    """Fixed messages, or a fixed error."""
    if error:
        raise OSError(error)
    return spark.createDataFrame(rows, MESSAGE)


def message(id_: str, subject: str | None = None, snippet: str | None = None, sender: str | None = None, to: list[str] | None = None, sent: str | None = None, body: str | None = None) -> tuple:
    """A row of MESSAGE; what is not given is null."""
    return (id_, subject, snippet, sender, to, sent, body)


def flattened() -> Column:
    """A message as lines of fields, without those that are null."""
    line = lambda head, c: F.concat(F.lit(f"{head}: "), c)
    return F.concat_ws("\n", line("Subject", F.col("subject")), line("From", F.col("from")), line("To", F.array_join("to", ", ")), line("Body", F.col("body")), line("Snippet", F.col("snippet")))


def rebuilt(df: DataFrame, column: str) -> DataFrame:
    """subject, from, to, body, snippet from such lines; of a body of several lines the first is found."""
    got = lambda head: F.nullif(F.regexp_extract(column, rf"(?m)^{head}: (.*)$", 1), F.lit(""))
    return df.withColumns({"subject": got("Subject"), "from": got("From"), "to": F.split(got("To"), ", "), "body": got("Body"), "snippet": got("Snippet")})


def headers(df: DataFrame) -> DataFrame:
    """subject, from, sent, to from an array of (name, value) structs `headers`: the first of each name in any case."""
    first = lambda n: F.get(F.filter("headers", lambda h: F.lower(h["name"]) == n), 0)["value"]
    return df.withColumns({"subject": first("subject"), "from": first("from"), "sent": first("date"), "to": F.transform(F.split(first("to"), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))})


def unread(df: DataFrame, most: int = 5) -> DataFrame:
    """Messages labelled UNREAD, five by default: the limit is the feature."""
    return df.filter(F.array_contains("label_ids", "UNREAD")).orderBy("id").limit(most)


def inbox(df: DataFrame, most: int) -> DataFrame:
    return df.orderBy("id").limit(min(most, 100))


def demo(spark: SparkSession) -> DataFrame:
    """Five invented messages that take the main branches of the rules."""
    rows = [("1", "Welcome to the annual plan", "Your plan is ready", "team@service.example", ["you@home.example"], None, "Welcome aboard"), ("2", "Urgent: meeting tomorrow", "Please confirm", "boss@work.example", ["you@home.example"], None, "The meeting is tomorrow at nine"), ("3", "Weekly tech newsletter digest", "AI news", "news@letters.example", ["you@home.example"], None, "Tech digest"), ("4", "You won a million", "lottery prize", "prize@odd.example", ["you@home.example"], None, "Click here to claim"), ("5", "Hello", None, None, None, None, None)]
    return spark.createDataFrame(rows, MESSAGE)
