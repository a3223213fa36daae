"""Figures over classified messages: accuracy, confusions, shares, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def with_truth(classified: DataFrame, truth: DataFrame) -> DataFrame:
    """id, category, truth of the messages that both have."""
    return classified.select("id", "category").join(truth.select("id", "truth"), "id")


def accuracy(judged: DataFrame) -> DataFrame:
    """truth (null: all), n, correct, accuracy."""
    right = F.col("category") == F.col("truth")
    return judged.rollup("truth").agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))


def misclassified(judged: DataFrame) -> DataFrame:
    return judged.filter("category != truth")


def false_spam(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if((F.col("category") == "Spam") & (F.col("truth") != "Spam")).alias("false_spam"))


def subjects_by_domain(messages: DataFrame) -> DataFrame:
    """domain (`unknown` without one), subject, n: a row for each subject, so that no domain's subjects are one list."""
    return messages.groupBy(F.coalesce(F.nullif(X.rule_domain(F.col("from")), F.lit("")), F.lit("unknown")).alias("domain"), "subject").agg(F.count("*").alias("n"))


# What tells a bucket, in turn, by sender (from) or subject.
BUCKETS = (("dev_notifications", ("github.com",), ("run failed",)), ("social_professional", ("linkedin.com",), ()), ("social_personal", ("facebook",), ()), ("security", ("no-reply@accounts.google.com",), ("security alert",)), ("newsletter", ("flipboard", "nytimes", "uefa"), ()), ("entertainment", ("spotify",), ()), ("business", (), ("rental", "request")), ("shopping", ("smood",), ()))


def content_bucket() -> Column:
    """What a message is about, by its sender and subject; `other` if nothing tells."""
    sender, subject = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("from", "subject"))
    out = F.lit("other")
    for name, senders, subjects in reversed(BUCKETS):
        out = F.when(F.exists(F.array(*[sender.contains(x) for x in senders], *[subject.contains(x) for x in subjects]), lambda hit: hit), F.lit(name)).otherwise(out)
    return out


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, id, subject, truth, reason of a ground-truth file {"email_ground_truth": {"test_emails": [...]}}."""
    row = "struct<file:string,id:string,subject:string,snippet:string,category:string,reason:string>"
    got = spark.read.schema(f"email_ground_truth struct<test_emails:array<{row}>>").option("multiLine", True).json(path)
    return got.select(F.explode("email_ground_truth.test_emails").alias("e")).select("e.file", "e.id", "e.subject", F.col("e.category").alias("truth"), "e.reason")


def gates(judged: DataFrame, least_recall: float = 0.75, most_false_spam: int = 0) -> DataFrame:
    """recall of ActionRequired, false spam and whether both pass, over (category, truth); without a message to act on, recall is null and passes."""
    need = F.col("truth") == "ActionRequired"
    got = judged.agg((F.count_if(need & (F.col("category") == "ActionRequired")) / F.nullif(F.count_if(need), F.lit(0))).alias("recall"), F.count_if((F.col("category") == "Spam") & (F.col("truth") != "Spam")).alias("false_spam"))
    return got.withColumn("passed", (F.coalesce("recall", F.lit(1.0)) >= least_recall) & (F.col("false_spam") <= most_false_spam))


def largest_share(classified: DataFrame) -> DataFrame:
    """n, categories, and the share of the most frequent category: near 1, the model says the same of everything."""
    return classified.groupBy("category").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("categories"), F.round(F.max("k") / F.sum("k"), 6).alias("largest_share"))


def same_each_time(runs: DataFrame) -> DataFrame:
    """id, same: whether all runs (id, run, category) agree."""
    return runs.groupBy("id").agg((F.count_distinct("category") == 1).alias("same"))


def recording_stats(recordings: DataFrame) -> DataFrame:
    """Recorded answers, and their categories in order."""
    return recordings.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


def completeness(column: Column) -> Column:
    return F.round(F.count(column) / F.count("*"), 6)
