"""Urgency, routing, execution, labels and mailbox state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.mail import DEFAULTS
from ..sources.store import numbered

# Keywords, labels and actions.
URGENT = ("urgent", "asap", "emergency", "critical", "immediate", "deadline", "time sensitive", "action required", "important")
URGENT_MAIN = (*URGENT, "breaking")
HUMAN = {"ActionRequired": "Action Required", "InterestingInfo": "Interesting", "Reference": "Reference", "Noise": "Low Priority", "Spam": "Spam"}
LABELS = {"actionrequired": "Agentic/Action Required", "action_required": "Agentic/Action Required", "interestinginfo": "Agentic/Interesting", "interesting_info": "Agentic/Interesting", "reference": "Agentic/Reference", "noise": "Agentic/Low Priority", "spam": "Agentic/Spam", "work": "Agentic/Work", "personal": "Agentic/Personal", "promotional": "Agentic/Promotional", "urgent": "Agentic/Urgent", "newsletter": "Agentic/Newsletter", "notification": "Agentic/Notification", "needsreview": "Agentic/Needs Review", "needs_review": "Agentic/Needs Review"}
TEST_PREFIX = "TEST_"
DESCRIPTIONS = {"ActionRequired": "Emails that require user action or response", "InterestingInfo": "Emails with valuable information but no action needed", "Reference": "Reference material to keep for later", "Noise": "Low priority emails or noise", "Spam": "Spam or unwanted emails"}
LEGACY = ("Action Required", "Interesting", "Reference", "Low Priority", "Spam", "Work", "Personal", "Promotional", "Urgent", "Newsletter", "Notification", "Needs Review", "AGENT_URGENT", "AGENT_PERSONAL", "AGENT_PROMOTIONAL", "AGENT_SPAM", "AGENT_NEEDS_REVIEW", "AGENT_WORK", "AGENT_INTERESTING", "AGENT_REFERENCE", "AGENT_NOISE", "AGENT_ACTION_REQUIRED")


def urgent(words: tuple[str, ...] = URGENT) -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit(DEFAULTS[c])) for c in ("subject", "snippet", "body")]))
    return text.rlike("|".join(words))


def production_label(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.lower(category))


def label_for(category: Column) -> Column:
    return F.coalesce(production_label(category), F.element_at(F.create_map(*[F.lit(x) for kv in HUMAN.items() for x in kv]), category))


def test_label(category: Column) -> Column:
    return F.concat(F.lit(TEST_PREFIX), F.coalesce(production_label(category), category))


def own_label(name: Column, legacy: tuple[str, ...] = ()) -> Column:
    return name.isin(*sorted({*LABELS.values(), *legacy})) | name.startswith("Agentic/") | name.startswith(TEST_PREFIX)


#: An action; `target` is a label, a folder, an address or a custom action's name, by kind. Parameters are sorted by key.
_ACTION = "struct<kind:string,target:string,note:string,reason:string,priority:tinyint,parameters:array<struct<key:string,value:string>>>"


def _action(kind: str, target: Column | str | None = None, note: str | None = None, reason: str | None = None, priority: int | None = None, parameters: dict[str, str] | None = None) -> Column:
    pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted((parameters or {}).items())]
    target = target if isinstance(target, Column) else F.lit(target)
    return F.struct(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit(note).cast("string").alias("note"), F.lit(reason).cast("string").alias("reason"), F.lit(priority).cast("tinyint").alias("priority"), (F.array(*pairs) if pairs else F.array().cast("array<struct<key:string,value:string>>")).alias("parameters"))


def label(name: Column | str) -> Column:
    return _action("Label", name)


def archived() -> Column:
    return _action("Archive")


def important() -> Column:
    return _action("MarkImportant")


def read() -> Column:
    return _action("MarkAsRead")


def forward(to: str, note: str | None = None) -> Column:
    return _action("Forward", to, note)


def move(folder: str) -> Column:
    return _action("MoveTo", folder)


def nothing() -> Column:
    return _action("NoAction")


def custom(name: str, parameters: dict[str, str] | None = None) -> Column:
    return _action("Custom", name, parameters=parameters)


def escalation(reason: str, priority: int) -> Column:
    """Priorities are 1 to 5."""
    return _action("Escalate", reason=reason, priority=min(5, max(1, priority)))


def without_runs(actions: Column) -> Column:
    """Consecutive equal actions are one."""
    return F.aggregate(actions, F.array().cast(f"array<{_ACTION}>"), lambda acc, x: F.when((F.size(acc) > 0) & F.element_at(acc, -1).eqNullSafe(x), acc).otherwise(F.concat(acc, F.array(x))))


def described(a: Column) -> Column:
    quoted = lambda head: F.concat(F.lit(f"{head} '"), a["target"], F.lit("'"))
    texts = {"Label": quoted("Apply label"), "Archive": F.lit("Archive email"), "MarkImportant": F.lit("Mark as important"), "MarkAsRead": F.lit("Mark as read"), "MoveTo": quoted("Move to folder")}
    texts["Forward"] = F.concat(F.lit("Forward to "), a["target"], F.coalesce(F.concat(F.lit(" with note: "), a["note"]), F.lit("")))
    texts["Escalate"] = F.concat(F.lit("Escalate (priority "), a["priority"].cast("string"), F.lit("): "), a["reason"])
    texts["Custom"] = F.concat(quoted("Custom action"), F.lit(" with "), F.size(a["parameters"]).cast("string"), F.lit(" parameters"))
    out = F.lit("No action needed")
    for kind, text in texts.items():
        out = F.when(a["kind"] == kind, text).otherwise(out)
    return out


def high_priority(a: Column) -> Column:
    return a["kind"].isin("MarkImportant", "Forward") | ((a["kind"] == "Escalate") & (a["priority"] >= 4))


def any_high_priority(actions: Column) -> Column:
    return F.exists(actions, high_priority)


def summary(actions: Column) -> Column:
    texts = F.transform(actions, described)
    return F.when(F.size(actions) == 0, F.lit("No actions")).when(F.size(actions) == 1, texts[0]).otherwise(F.concat(F.size(actions).cast("string"), F.lit(" actions: "), F.array_join(texts, ", ")))


def unit(x: float) -> float:
    """Thresholds and confidences are 0 to 1."""
    return min(1.0, max(0.0, x))


def single(action: Column) -> Column:
    return F.struct(F.array(action).alias("actions"), F.lit(1.0).alias("confidence"))


def category_error(category: Column) -> Column:
    """Null for a category, else what is wrong with it; names are told apart by case."""
    return F.when(~F.coalesce(category.isin(*HUMAN), F.lit(False)), F.concat(F.lit("Invalid email category '"), F.coalesce(category, F.lit("")), F.lit(f"'. Valid categories: {', '.join(HUMAN)}")))


def category_description(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv]), category)


def production_labels() -> list[str]:
    return list(dict.fromkeys(LABELS.values()))


def test_labels(prefix: str = TEST_PREFIX) -> list[str]:
    return [f"{prefix}{c}" for c in HUMAN]


def is_test_label(name: Column) -> Column:
    return name.startswith(TEST_PREFIX)


def agentic(name: Column) -> Column:
    """Labels that this or an older version has made."""
    return own_label(name, LEGACY)


@dataclass(frozen=True)
class Routing:
    """What a router does: actions by category, below the threshold, and for urgent messages. `with_` gives a changed copy."""

    categories: dict[str, list[Column]]
    low_confidence: list[Column]
    urgent: list[Column]
    threshold: float = 0.7

    @classmethod
    def usual(cls) -> Routing:
        made = lambda key: label(LABELS[key])
        kept = {"ActionRequired": [made("actionrequired")], "InterestingInfo": [made("interestinginfo")]}
        gone = {c: [made(c.lower()), archived()] for c in ("Reference", "Noise", "Spam")}
        return cls(kept | gone, [made("needs_review")], [important(), escalation("High priority email", 4)])

    def with_(self, *, category: str | None = None, actions: list[Column] | None = None, threshold: float | None = None, low_confidence: list[Column] | None = None, urgent: list[Column] | None = None) -> Routing:
        categories = self.categories | ({category: actions or []} if category else {})
        return Routing(categories, self.low_confidence if low_confidence is None else low_confidence, self.urgent if urgent is None else urgent, self.threshold if threshold is None else unit(threshold))


def _array(actions: list[Column]) -> Column:
    return F.array(*actions) if actions else F.array().cast(f"array<{_ACTION}>")


def route(classified: DataFrame, routing: Routing | None = None) -> DataFrame:
    """Adds actions, confidence, reasoning. A category without actions of its own is labelled with its human name; no actions at all are one that says so."""
    r = routing or Routing.usual()
    confidence = F.coalesce("score", F.lit(1.0))
    human = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HUMAN.items() for x in kv]), F.col("category")), F.col("category"))
    own = F.array(label(human))
    for category, actions in r.categories.items():
        own = F.when(F.col("category") == category, _array(actions)).otherwise(own)
    low, pressing = confidence < r.threshold, urgent()
    chosen = without_runs(F.concat(F.when(pressing, _array(r.urgent)).otherwise(_array([])), F.when(low, _array(r.low_confidence)).otherwise(own)))
    why = F.concat_ws(", ", F.when(pressing, "urgent content detected"), F.when(low, F.format_string("low confidence (%.2f)", confidence)).otherwise(F.concat(F.lit("category: "), F.col("category"))), F.when(F.size(chosen) == 0, "no matching rules"))
    return classified.withColumns({"actions": F.when(F.size(chosen) == 0, F.array(nothing())).otherwise(chosen), "confidence": confidence, "reasoning": F.format_string("Rule-based routing: %s (confidence: %.2f)", why, confidence)})


def decided(classified: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds stay_in_inbox and why (what is reported) and archived (what is done): the two differ by design."""
    why = F.when(F.col("category") == "ActionRequired", "Action required").when(urgent(URGENT_MAIN), "Urgent content detected").when(F.col("score") < threshold, F.format_string("Low confidence (%.2f) - needs review", "score"))
    return classified.withColumns({"stay_in_inbox": why.isNotNull(), "why": F.coalesce(why, F.lit("Archived based on classification")), "archived": F.col("category") != "ActionRequired"})


def dry_run(classified: DataFrame) -> DataFrame:
    """Adds archived and urgent as a run without changes reports them: urgent is a matter of the subject alone."""
    return classified.withColumns({"archived": F.col("category") != "ActionRequired", "urgent": F.contains(F.lower(F.coalesce("subject", F.lit(""))), F.lit("urgent"))})


def inbox_report(run: DataFrame) -> DataFrame:
    """One row for each category and one (category null) for all, of a run (category, archived, urgent, error): processed, errors, kept, archived, urgent, share (per cent of the processed, one decimal)."""
    ok = F.col("error").isNull()
    counts = run.rollup("category").agg(F.grouping("category").alias("_all"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors"), F.count_if(ok & ~F.col("archived")).alias("kept"), F.count_if(ok & F.col("archived")).alias("archived"), F.count_if(ok & F.col("urgent")).alias("urgent"))
    total = F.max(F.when(F.col("_all") == 1, F.col("processed"))).over(Window.partitionBy())
    # a window over the few categories; rows without one are errors, which the total alone counts
    return counts.withColumn("share", F.when(total > 0, F.round(F.col("processed") * 100 / total, 1))).filter((F.col("_all") == 1) | F.col("category").isNotNull()).drop("_all")


def stats(decided_: DataFrame, threshold: float = 0.7) -> DataFrame:
    low = F.col("score") < threshold
    return decided_.agg(F.count("*").alias("total"), F.count_if("stay_in_inbox").alias("kept"), F.count_if(~F.col("stay_in_inbox")).alias("archived"), F.count_if(urgent(URGENT_MAIN)).alias("urgent"), F.count_if(F.col("stay_in_inbox") & low).alias("needs_review"))


#: What errors of a kind begin with: those of reading messages and those of acting on them.
FETCH_ERRORS = {"network": "Network error", "auth": "Authentication error", "config": "Configuration error", "unknown": "Unknown error"}
ACTION_ERRORS = {"labeling_failed": "Labeling failed", "archive_failed": "Archive failed", "invalid_category": "Invalid category", "config": "Configuration error", "unknown": "Unknown action execution error"}


def typed_error(kind: str, message: Column, kinds: dict[str, str] = ACTION_ERRORS) -> Column:
    """An error beside the result: kind, message, and the text that is shown."""
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"), F.concat(F.lit(f"{kinds[kind]}: "), message).alias("shown"))


def executed(classified: DataFrame, labels: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Audit rows: id, category, label_applied, archived, actions_taken, summary, error (kind, message, shown; null: done).

    labels (name): those that a mailbox has; the first message by `order` that needs another one makes it. label_ids, if there,
    tell messages that were archived before. Messages without an id, or of no known category, have an error and nothing else.
    """
    goes = F.col("category") != "ActionRequired"
    no_id = F.coalesce(F.col("id").cast("string"), F.lit("")) == ""
    wrong = ~F.coalesce(F.col("category").isin(*HUMAN), F.lit(False))
    error = F.when(wrong, typed_error("invalid_category", F.coalesce("category", F.lit("")))).when(no_id, typed_error("labeling_failed", F.concat(F.lit("Failed to apply label '"), label_for(F.col("category")), F.lit("': Email ID cannot be empty"))))
    rows = classified.withColumns({"_error": error, "_label": label_for(F.col("category"))})
    made = F.lit(False)
    if labels is not None:
        missing = rows.filter("_error IS NULL").groupBy(F.col("_label").alias("name")).agg(F.min(order).alias("_first")).join(labels.select("name"), "name", "left_anti")
        # one row for each label, of which there are as many as categories
        rows = rows.join(F.broadcast(missing.withColumnRenamed("name", "_name")), F.col("_label") == F.col("_name"), "left")
        made = F.coalesce(F.col("_first") == F.col(order), F.lit(False))
    there = F.coalesce(F.array_contains("label_ids", "INBOX"), F.lit(False)) if "label_ids" in classified.columns else F.lit(True)
    last = F.when(~goes, "Kept in inbox (ActionRequired category)").when(there, "Archived email (removed from inbox)").otherwise("Email was already archived")
    taken = F.array_compact(F.array(F.concat(F.lit("Applied label: "), "_label"), F.when(made, F.concat(F.lit("Created new label: "), "_label")), last))
    summary_ = F.concat(F.lit("Applied label '"), "_label", F.when(goes, F.lit("' and archived email")).otherwise(F.lit("' and kept in inbox (ActionRequired)")))
    done = F.col("_error").isNull()
    return rows.select("id", "category", F.when(done, F.col("_label")).alias("label_applied"), F.when(done, goes).alias("archived"), F.when(done, taken).alias("actions_taken"), F.when(done, summary_).alias("summary"), F.col("_error").alias("error"))


def apply_labels(messages: DataFrame, labels: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, labels) after each wanted (message_id, label) is applied; labels that are missing are made, twice is as once."""
    known = labels.select("id", "name")
    new = wanted.filter(F.col("label") != "").select(F.col("label").alias("name")).distinct().join(known, "name", "left_anti").select(F.replace(F.lower(F.concat(F.lit("label_"), "name")), F.lit(" "), F.lit("_")).alias("id"), "name")
    all_ = known.unionByName(new)
    ids = wanted.join(all_.select(F.col("id").alias("label_id"), F.col("name").alias("label")), "label").groupBy(F.col("message_id").alias("id")).agg(F.sort_array(F.collect_set("label_id")).alias("_more"))
    return messages.join(ids, "id", "left").select(*[c for c in messages.columns if c != "label_ids"], F.array_union(F.coalesce("label_ids", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))).alias("label_ids")), all_


def archive(messages: DataFrame) -> DataFrame:
    """Messages without INBOX and what was done; one without an id (the first column) is left as it is, with an error."""
    there = F.array_contains("label_ids", "INBOX")
    no_id = F.coalesce(F.col(messages.columns[0]).cast("string"), F.lit("")) == ""
    return messages.withColumns({"description": F.when(no_id, "Email ID cannot be empty").when(there, "Archived").otherwise("Email was already archived"), "label_ids": F.when(no_id, F.col("label_ids")).otherwise(F.array_remove("label_ids", "INBOX"))})


def is_archived() -> Column:
    return ~F.coalesce(F.array_contains("label_ids", "INBOX"), F.lit(False))


def by_label(messages: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(messages that have the label, labels; a label that is missing is made)."""
    new = labels.sparkSession.createDataFrame([("label_" + name.lower().replace(" ", "_"), name)], "id string, name string")
    all_ = labels.select("id", "name").unionByName(new.join(labels.select("name"), "name", "left_anti").select("id", "name"))
    ids = all_.filter(F.col("name") == name).select(F.col("id").alias("label_id"))
    return messages.join(F.broadcast(ids), F.array_contains(messages["label_ids"], F.col("label_id")), "left_semi"), all_


def label_names(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """id, labels: names of each message's labels; unknown ids are dropped."""
    return messages.select("id", F.explode("label_ids").alias("label_id")).join(labels.select(F.col("id").alias("label_id"), "name"), "label_id").groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("labels"))


def drop_labels(messages: DataFrame, labels: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """(messages, labels) without the labels for which `which` (over name) holds."""
    gone = labels.filter(which).select("id")
    kept = labels.join(gone, "id", "left_anti")
    left = messages.select("id", F.explode("label_ids").alias("label_id")).join(gone.withColumnRenamed("id", "label_id"), "label_id", "left_anti").groupBy("id").agg(F.collect_list("label_id").alias("label_ids"))
    return messages.drop("label_ids").join(left, "id", "left").withColumn("label_ids", F.coalesce("label_ids", F.array().cast("array<string>"))), kept


def first_seen(values: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value, seed: 0, 1, ... by the first place in `order`; distinct values alone are numbered."""
    first = values.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first"], "seed").select(value, "seed")
