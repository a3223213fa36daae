"""Literal messages and what is expected of them, stated by hand: rules, urgency and routing are checked against these and not against their own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import mail

AR, II, REF, NOISE, SPAM = "ActionRequired", "InterestingInfo", "Reference", "Noise", "Spam"
_KIND = "k int, subject string, snippet string, sender string, body string"
#: subject, snippet, sender, body; category and score of the rules, of the sure rules (None: none holds), of the fallback; urgent for the router, for the main run, in a dry run.
CASES = [
    ("Build CI failed on main", None, "ci@build.example", None, AR, 0.9, AR, 0.95, REF, 0.6, False, False, False),
    ("Meeting tomorrow", "Please confirm", "boss@work.example", None, AR, 0.9, None, None, REF, 0.6, False, False, False),
    ("Team meeting reminder", None, "boss@work.example", None, AR, 0.9, None, None, REF, 0.6, False, False, False),
    ("URGENT: server down", "call back", "ops@work.example", None, AR, 0.9, AR, 0.9, REF, 0.6, True, True, True),
    ("Parents evening at school", None, "office@town.example", None, AR, 0.9, AR, 0.88, REF, 0.6, False, False, False),
    ("Ticket transfer pending", None, "desk@hall.example", None, AR, 0.9, AR, 0.92, REF, 0.6, False, False, False),
    ("Tech digest", "New AI tools", "digest@letters.example", None, II, 0.85, None, None, REF, 0.6, False, False, False),
    ("Security alert: new device", "a login from Bern", "safety@bank.example", None, II, 0.85, II, 0.85, REF, 0.6, False, False, False),
    ("Economics of shipping", None, "desk@paper.example", None, II, 0.85, II, 0.83, REF, 0.6, False, False, False),
    ("Your receipt", "from the bakery", "till@bakery.example", None, REF, 0.8, REF, 0.92, REF, 0.6, False, False, False),
    ("Your parcel was delivered", None, "post@parcel.example", None, REF, 0.8, REF, 0.9, REF, 0.6, False, False, False),
    ("Welcome to your plan", None, "team@phone.example", None, REF, 0.8, REF, 0.85, REF, 0.6, False, False, False),
    ("BBQ on Sunday", None, "ann@home.example", None, REF, 0.8, None, None, REF, 0.6, False, False, False),
    ("You won a million", "lottery prize", "prize@odd.example", None, SPAM, 0.95, None, None, REF, 0.6, False, False, False),
    ("Flash sale ends soon", "special prices", "shop@store.example", None, NOISE, 0.85, NOISE, 0.9, NOISE, 0.7, False, False, False),
    ("Limited time offer", None, "shop@store.example", None, NOISE, 0.85, NOISE, 0.9, NOISE, 0.7, False, False, False),
    ("Hello", None, "news@mailchimp.example", None, NOISE, 0.85, NOISE, 0.92, REF, 0.6, False, False, False),
    ("Hello", None, "you@m.linkedin.example", None, NOISE, 0.85, NOISE, 0.88, REF, 0.6, False, False, False),
    ("Someone liked your photo", None, "you@pictures.example", None, NOISE, 0.85, None, None, REF, 0.6, False, False, False),
    ("People you may know", None, "you@people.example", None, NOISE, 0.85, None, None, NOISE, 0.7, False, False, False),
    ("Recommended for you", None, "you@shelf.example", None, NOISE, 0.85, NOISE, 0.88, REF, 0.6, False, False, False),
    ("Items to pair with your coat", None, "you@shelf.example", None, NOISE, 0.85, NOISE, 0.88, REF, 0.6, False, False, False),
    ("Healthy living", "ideas for spring", "you@gym.example", None, NOISE, 0.85, None, None, REF, 0.6, False, False, False),
    ("Concert tickets available now", None, "box@hall.example", None, NOISE, 0.85, None, None, REF, 0.6, False, False, False),
    ("Events near you", "this Sunday", "box@hall.example", None, NOISE, 0.85, None, None, NOISE, 0.7, False, False, False),
    ("Rental car", "driver booking", "desk@cars.example", None, REF, 0.6, AR, 0.89, REF, 0.6, False, False, False),
    ("Angebot", "jetzt sparen", "laden@markt.example", None, REF, 0.6, NOISE, 0.9, REF, 0.6, False, False, False),
    ("Lunch on Sunday", "at noon", "ann@home.example", None, REF, 0.6, None, None, REF, 0.6, False, False, False),
    ("Breaking: storm tonight", None, "desk@paper.example", None, REF, 0.6, None, None, REF, 0.6, False, True, False),
    ("Status report", "all is well", "ops@work.example", "There is an EMERGENCY at the plant", REF, 0.6, None, None, REF, 0.6, True, True, False),
    ("Regular notes", "of the board", "ceo@work.example", "Please read the numbers", REF, 0.6, None, None, REF, 0.6, False, False, False),
    ("Important: lunch offer", None, "shop@store.example", None, NOISE, 0.85, None, None, NOISE, 0.7, True, True, False),
    (None, None, None, None, REF, 0.6, None, None, REF, 0.6, False, False, False),
]
#: The same in SQL: a table c of the cases, met by documents whose id has the case's remainder.
_COLUMNS = "k, subject, snippet, sender, body, category, score, sure_category, sure_score, fall_category, fall_score, router_urgent, main_urgent, dry_urgent"


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).upper() if isinstance(value, bool) else str(value)


SQL = f"c({_COLUMNS}) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, (k, *case))) + ')' for k, case in enumerate(CASES))}), m AS (SELECT CAST(doc_id AS VARCHAR) AS id, c.* FROM documents JOIN c ON doc_id % {len(CASES)} = k)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each document: the case that its id's remainder names."""
    known = spark.createDataFrame([(k, *case[:4]) for k, case in enumerate(CASES)], _KIND)
    ids = mail.table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(len(CASES))).cast("int").alias("k"))
    made = ids.join(F.broadcast(known), "k")
    return made.select(F.col("doc_id").cast("string").alias("id"), "subject", "snippet", F.col("sender").alias("from"), F.lit(None).cast("array<string>").alias("to"), F.lit(None).cast("string").alias("sent"), "body")
