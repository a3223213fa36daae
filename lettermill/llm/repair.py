"""Conversation structure repair: the cheapest edits that make a conversation alternate, as a fold in Spark SQL.

A conversation's roles have to read (s?(ua)+)? by their initials. Turns are kept (0), given the other role (3),
deleted (4) or, empty, inserted (3); blank and repeated turns have to go, a truncated one that stays costs 3. A fold
over the sorted turns carries, for each of the four states that the pattern has (nothing yet, after the system's
turn, after the user's, after the assistant's), the least (cost, audit) struct, audit being the edits' initials.
Of audits that cost the same none begins another in one state, so the least of a prefix stays the least.

A conversation may hold a third of all rows. Turns are therefore sorted by ranges over (conv_id, turn, role, text)
and folded in blocks of BLOCK neighbours, from each of the four states in which a block may begin; blocks are joined
like matrices (least for sum, plus for product), FAN of them at a time, until one is left for each conversation.
Whatever lies in one block, as nearly all conversations do, is settled in it and never shuffled again. Repeats of a
turn are found by a window within the block, and by a window over the blocks' distinct turns across blocks.
Only the hash of a repaired conversation, which is a chain by nature, sees one conversation in one task: a stream of
blocks that holds one batch in memory.

Defined results: null conv_id is one conversation; null roles and texts are one blank character; turns that have no
number come first; turns of one number are ordered by role and text, repeated rows are neighbours; an empty table
gives no rows; a conversation without turns has zeros and an empty audit; extra columns are ignored. Texts of any length are
compared by their SHA-256. `illegal` counts neighbours whose initials are none of su, ua, au.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import stored, tune

#: Neighbours folded at once, and blocks joined at once.
BLOCK, FAN = 512, 64
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
STATES = ("n", "s", "u", "a")
_WAY = "struct<cost:bigint,audit:string,path:array<struct<block:bigint,entry:int,audit:string>>>"
_WAYS = f"struct<{','.join(f'{s}:{_WAY}' for s in STATES)}>"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of each row after damage by crc32 of conv_id:turn: dropped (copies 0), emptied, without stops, doubled, given to the user."""
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_r"))
    text = F.when(F.col("_r") == 1, "").when(F.col("_r") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return clean.select("conv_id", "turn", F.when(F.col("_r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_r") == 0, 0).when(F.col("_r") == 3, 2).otherwise(1).alias("copies"))


def _placed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A row for each copy (one that is `gone` where there is none), numbered by conv_id, turn, role and text; `block` has BLOCK neighbours."""
    each = rows.select("conv_id", "turn", "role", "text", (F.col("copies") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("_copy"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    # a number in the partition that read the row parts equal rows, so that no range has to hold all of them
    dealt = each.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    end = F.rtrim("text", F.lit(BLANKS))
    blank, last = end == "", F.substring(end, -1, 1)
    judged = dealt.withColumn("at", F.monotonically_increasing_id()).select("conv_id", "at", F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), "turn", "role", "text", "gone", blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("truncated"), F.when(~blank & ~F.col("gone"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"))
    return stored(spark, judged, "turns")


def _one(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _then(way: Column, cost: Column | int, letter: Column | str) -> Column:
    """A way with one more edit; null stays null."""
    more = F.struct((way["cost"] + F.lit(cost) if isinstance(cost, int) else way["cost"] + cost).alias("cost"), F.concat(way["audit"], F.lit(letter) if isinstance(letter, str) else letter).alias("audit"))
    return F.when(way.isNotNull(), more)


def _closed(w: Column) -> Column:
    """Ways with the turns that may be inserted after them."""
    more = lambda s: _then(w[s], INSERT, "I")
    users = F.least(w["u"], more("n"), more("s"), more("a"))
    return _one(users, lambda u: F.struct(w["n"].alias("n"), w["s"].alias("s"), u.alias("u"), F.least(w["a"], _then(u, INSERT, "I")).alias("a")))


def _taken(w: Column, x: Column) -> Column:
    """Ways after turn x: deleted, kept or given the other role."""
    stays = F.when(x["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")
    gone = lambda s: _then(w[s], DELETE, "D")

    def as_(initial: str, s: str) -> Column:
        right = x["initial"] == initial
        return F.when(~x["dead"], _then(w[s], stays + F.when(right, 0).otherwise(RETITLE), F.when(right, F.lit("K")).otherwise(F.lit("R"))))

    system = F.when(~x["dead"] & (x["initial"] == "s"), _then(w["n"], stays, "K"))
    return F.struct(gone("n").alias("n"), F.least(gone("s"), system).alias("s"), F.least(gone("u"), as_("u", "n"), as_("u", "s"), as_("u", "a")).alias("u"), F.least(gone("a"), as_("a", "u")).alias("a"))


def _begin(entry: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.struct(*[F.when(entry == k, zero).alias(s) for k, s in enumerate(STATES)])


def folded(turns: Column, entry: Column) -> Column:
    """The ways through the turns (structs of initial, dead, truncated) from one state."""
    return F.aggregate(turns, _closed(_begin(entry)), lambda w, x: _one(_taken(w, x), _closed))


def _summary(turns: Column, block: Column) -> dict[str, Column]:
    """What a block says of itself, in a form that blocks can be joined by."""
    here = F.filter(turns, lambda x: ~x["gone"])
    initials = F.transform(here, lambda x: x["initial"])
    numbers = F.array_compact(F.transform(here, lambda x: x["turn"]))
    steps = F.zip_with(F.slice(initials, 1, F.greatest(F.size(here) - 1, F.lit(0))), F.slice(initials, 2, F.greatest(F.size(here) - 1, F.lit(0))), lambda p, q: F.concat(p, q))
    count = lambda f: F.size(F.filter(here, f)).cast("long")
    entry = lambda ways, e: F.struct(*[F.when(ways[s].isNotNull(), F.struct(ways[s]["cost"].alias("cost"), ways[s]["audit"].alias("audit"), F.array(F.struct(block.alias("block"), e.cast("int").alias("entry"), ways[s]["audit"].alias("audit"))).alias("path"))).alias(s) for s in STATES])
    return {
        "first_initial": F.get(initials, 0), "last_initial": F.get(initials, F.size(here) - 1), "illegal": F.size(F.filter(steps, lambda p: ~p.isin("su", "ua", "au"))).cast("long"),
        "first_turn": F.get(numbers, 0), "last_turn": F.get(numbers, F.size(numbers) - 1), "distinct_turns": F.size(F.array_distinct(numbers)).cast("long"),
        "blank": count(lambda x: x["blank"]), "duplicate": count(lambda x: x["repeats"]), "truncated": count(lambda x: x["truncated"] & ~x["repeats"]),
        "ways": F.transform(F.array(*map(F.lit, range(len(STATES)))), lambda e: _one(folded(here, e), lambda w: entry(w, e))),
    }


def _joined(a: Column, b: Column) -> Column:
    """The summary of two neighbours."""

    def on(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), F.struct((x["cost"] + y["cost"]).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit"), F.concat(x["path"], y["path"]).alias("path")))

    both = lambda c: a[c] + b[c]
    ways = F.transform(a["ways"], lambda w: F.struct(*[F.least(*[on(w[m], b["ways"][k][s]) for k, m in enumerate(STATES)]).alias(s) for s in STATES]))
    meet = a["last_initial"].isNotNull() & b["first_initial"].isNotNull() & ~F.concat(a["last_initial"], b["first_initial"]).isin("su", "ua", "au")
    return F.struct(
        F.coalesce(a["first_initial"], b["first_initial"]).alias("first_initial"), F.coalesce(b["last_initial"], a["last_initial"]).alias("last_initial"), (both("illegal") + F.coalesce(meet, F.lit(False)).cast("long")).alias("illegal"),
        F.coalesce(a["first_turn"], b["first_turn"]).alias("first_turn"), F.coalesce(b["last_turn"], a["last_turn"]).alias("last_turn"), (both("distinct_turns") - F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)).cast("long")).alias("distinct_turns"),
        both("blank").alias("blank"), both("duplicate").alias("duplicate"), both("truncated").alias("truncated"), ways.alias("ways"),
    )


def _settled(df: DataFrame) -> DataFrame:
    """df with the conversation's figures from a summary `all` of the whole of it."""
    best = F.least(F.col("all.ways")[0]["n"], F.col("all.ways")[0]["a"])
    gaps = F.coalesce(F.col("all.last_turn") - F.col("all.first_turn") + 1 - F.col("all.distinct_turns"), F.lit(0).cast("long"))
    return df.withColumn("best", best).withColumns({"gaps": gaps, **{c: F.col(f"all.{c}") for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": F.col("best.cost"), "audit": F.col("best.audit"), "path": F.col("best.path")}).drop("all", "best")


def rendered(turns: Column, entry: Column, audit: Column) -> Column:
    """The repaired turns (role, text) of a block that begins in state `entry`."""
    row = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    start = F.struct(F.array().cast("array<struct<role:string,text:string>>").alias("out"), F.lit(0).alias("at"), entry.alias("state"))

    def step(acc: Column, letter: Column) -> Column:
        x = F.get(turns, acc["at"])
        # the next of the two roles; only a kept system turn leads to state 1
        wants = F.when(acc["state"] == 2, "assistant").otherwise("user")
        after = F.when((letter == "K") & (x["initial"] == "s"), 1).when(acc["state"] == 2, 3).otherwise(2)
        new = F.when(letter == "K", row(x["role"], x["text"])).when(letter == "R", row(wants, x["text"])).otherwise(row(wants, F.lit("")))
        return F.when(letter == "D", F.struct(acc["out"].alias("out"), (acc["at"] + 1).alias("at"), acc["state"].alias("state"))).otherwise(F.struct(F.concat(acc["out"], F.array(new)).alias("out"), (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"), after.alias("state")))

    return F.aggregate(F.filter(F.split(audit, ""), lambda c: c != ""), start, step)["out"]


def repaired(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row for each block of a conversation: conv_id, block (its place), turns (array of role, text), and in a conversation's first block alone gaps, blank, duplicate, truncated, illegal, cost, audit.

    rows: conv_id, turn, role, text, copies (0: the row is not there, but its conversation is).
    """
    tune(spark)
    placed = _placed(spark, rows)
    key = ["conv_id", "block"]
    blocks = placed.groupBy(*key).agg(F.count("*").alias("_n"))
    split = stored(spark, blocks.withColumn("_all", F.count("*").over(Window.partitionBy("conv_id"))).filter("_all > 1").select(*key, "_all"), "split")
    known = lambda other: (F.col("conv_id").eqNullSafe(F.col("_c"))) & (F.col("block") == F.col("_b"))
    named = lambda df, *more: df.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), *more)
    # turns of a conversation of several blocks that an earlier block has had
    narrow = placed.filter(F.col("same").isNotNull()).select(*key, "same").join(named(split), known(split), "left_semi").distinct()
    earlier = narrow.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("block"))).filter("_k > 1").groupBy(*key).agg(F.collect_set("same").alias("had"))
    facts = split.join(named(earlier, "had"), known(earlier), "left").select(*key, "_all", F.coalesce("had", F.array().cast("array<string>")).alias("had"))
    again = (F.row_number().over(Window.partitionBy(*key, "same").orderBy("at")) > 1) & F.col("same").isNotNull()
    flagged = placed.repartition(*key).withColumn("again", again)
    turn = F.struct("at", "turn", "role", "text", "gone", "blank", "truncated", "again", "same")
    whole = flagged.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("t")).join(named(facts, "_all", "had"), known(facts), "left").drop("_c", "_b")

    def told(x: Column) -> Column:
        repeats = x["again"] | F.coalesce(F.array_contains("had", x["same"]), F.lit(False))
        # each turn's first fault counts: blank, repeated, truncated
        return F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), F.substring(x["role"], 1, 1).alias("initial"), x["gone"].alias("gone"), x["blank"].alias("blank"), repeats.alias("repeats"), (x["blank"] | repeats).alias("dead"), x["truncated"].alias("truncated"))

    ready = whole.withColumn("t", F.transform("t", told))
    summed = stored(spark, ready.select(*key, "_all", F.struct(*[c.alias(n) for n, c in _summary(F.col("t"), F.col("block")).items()]).alias("all"), F.filter("t", lambda x: ~x["gone"]).alias("t")), "blocks")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    single = _settled(summed.filter("_all IS NULL")).select("conv_id", F.lit(0).alias("place"), rendered(F.col("t"), F.lit(0), F.col("audit")).alias("turns"), *figures)
    # conversations of several blocks, FAN neighbours at a time
    level = split.withColumn("group", F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1)
    most = split.agg(F.max("_all")).first()[0]
    part = summed.filter("_all IS NOT NULL").select(*key, "all").join(named(level, "group"), known(level)).select("conv_id", "group", "all")
    while most is not None and most > 1:
        grouped = part.groupBy("conv_id", F.floor(F.col("group") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("group", "all"))).alias("g"))
        parts = F.transform("g", lambda x: x["all"])
        part = stored(spark, grouped.select("conv_id", F.col("up").alias("group"), F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], _joined).alias("all")), "joined")
        most = -(-most // FAN)
    final = _settled(part).select("conv_id", F.posexplode("path").alias("place", "p"), *figures)
    first = [F.when(F.col("place") == 0, F.col(c)).alias(c) for c in figures]
    ways = final.select(F.col("conv_id").alias("_c"), F.col("p.block").alias("_b"), "place", F.col("p.entry").alias("entry"), F.col("p.audit").alias("part"), *[c.alias(f"_{n}") for c, n in zip(first, figures, strict=True)])
    several = summed.filter("_all IS NOT NULL").select(*key, "t").join(ways, known(ways)).select("conv_id", "place", rendered(F.col("t"), F.col("entry"), F.col("part")).alias("turns"), *[F.col(f"_{n}").alias(n) for n in figures])
    return single.unionByName(several)


def digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of its role:text, one a line)."""
    got = stored(spark, repaired(spark, rows).select("conv_id", "place", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("text"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "repaired")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    many = got.filter("place > 0").select("conv_id").distinct()
    # one block: hashed where it is; several: in turn, in a stream
    long = got.join(many.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    short = got.join(many.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti").select("conv_id", *figures, F.sha2("text", 256).alias("repaired_sha256"))
    out = short.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, chain, some = None, None, False
        done: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if r["place"] == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": chain.hexdigest()})
                    head, chain, some = {c: r[c] for c in ("conv_id", *figures)}, hashlib.sha256(), False
                if r["n"]:
                    chain.update((("\n" if some else "") + r["text"]).encode())
                    some = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if head is not None:
            yield pa.RecordBatch.from_pylist([head | {"repaired_sha256": chain.hexdigest()}], schema)

    schema = to_arrow_schema(out)
    return short.unionByName(long.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, out))


def oracle() -> str:
    """DuckDB SQL for the rows of digest(damage(conversations)): one turn of all conversations a step, states as (cost and audit, repaired text)."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    crc = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"

    def then(state: str, cost: str, letter: str, line: str = "NULL") -> str:
        k = f"lpad(CAST(CAST(left({state}.k, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}.k, 13) || {letter}"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {k}, 'o': CASE WHEN {line} IS NULL THEN {state}.o WHEN {state}.o IS NULL THEN {line} ELSE {state}.o || chr(10) || {line} END}} END"

    def stays(state: str, initial: str) -> str:
        name = {"u": "'user'", "a": "'assistant'", "s": "''"}[initial]
        return f"CASE WHEN NOT dead THEN {then(state, f'late + CASE WHEN i = {chr(39)}{initial}{chr(39)} THEN 0 ELSE 3 END', f'CASE WHEN i = {chr(39)}{initial}{chr(39)} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END', f'(CASE WHEN i = {chr(39)}{initial}{chr(39)} THEN role ELSE {name} END || {chr(39)}:{chr(39)} || text)')} END"

    def settled(source: str, keys: str) -> str:
        more = lambda s, r: then(s, "3", "'I'", f"'{r}:'")
        users = f"SELECT {keys}, n, s, a, least(u, {more('n', 'user')}, {more('s', 'user')}, {more('a', 'user')}) AS u FROM ({source})"
        return f"SELECT {keys}, n, s, u, least(a, {more('u', 'assistant')}) AS a FROM ({users})"

    none = "CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR))"
    begin = f"SELECT DISTINCT conv_id, 0 AS k, {{'k': '000000000000', 'o': CAST(NULL AS VARCHAR)}} AS n, {none} AS s, {none} AS u, {none} AS a FROM conversations"
    taken = f"SELECT w.conv_id, f.k, {then('n', '4', chr(39) + 'D' + chr(39))} AS n, least({then('s', '4', chr(39) + 'D' + chr(39))}, CASE WHEN i = 's' THEN {stays('n', 's')} END) AS s, least({then('u', '4', chr(39) + 'D' + chr(39))}, {stays('n', 'u')}, {stays('s', 'u')}, {stays('a', 'u')}) AS u, least({then('a', '4', chr(39) + 'D' + chr(39))}, {stays('u', 'a')}) AS a FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS r FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role, CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, {blanks}) AS kept, left(role, 1) AS i FROM hurt),
g AS (SELECT *, kept = '' AS blank, kept <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair FROM t),
f AS (SELECT *, blank OR again AS dead, NOT blank AND NOT again AND right(kept, 1) NOT IN ('.', '!', '?') AS cut, CASE WHEN cut THEN 3 ELSE 0 END AS late FROM g),
w AS ({settled(begin, 'conv_id, k')} UNION ALL {settled(taken, 'conv_id, k')}),
last AS (SELECT conv_id, least(arg_max(n, k), arg_max(a, k)) AS best FROM w GROUP BY conv_id),
found AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT last.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(best.k, 12) AS BIGINT) AS cost, substr(best.k, 13) AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256 FROM last LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM last.conv_id"""
