"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A fixed mask reads some token positions of a window and ignores the others, so a hit survives substitutions at
the ignored ones. Seeds of all documents are joined to the seeds of the benchmark, a block of items at a
time (blocks bound what is broadcast); around each hit the document's tokens are laid on the item's, and an
overlap counts where a stretch of STRETCH tokens (the whole item, if it is shorter) agrees in LEAST of them.

Defined results: null and empty texts have no tokens and no overlaps; an item shorter than the shortest mask
is compared whole, as one run of tokens; tokens are runs of letters and digits in lower case; repeated rows and items
are compared each, and give one row for each pair of ids; empty tables give no rows; a null id is kept;
extra columns are ignored; texts of any length are compared whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Token offsets that each mask reads.
MASKS = ((0, 1, 2, 4, 5, 7), (0, 2, 3, 6, 7, 8))
STRETCH = 13
LEAST = 0.8
#: Seeds of one block of items, which are broadcast.
BLOCK_SEEDS = 200_000
#: Names of overlapping texts, of which at most so many are broadcast.
BROADCAST_ROWS = 250_000


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(h: Column) -> Column:
    """Seeds of all masks at all places, as (seed, place)."""
    n = F.size(h)

    def of(k: int) -> Column:
        mask = MASKS[k]
        made = F.transform(F.sequence(F.lit(0), n - F.lit(mask[-1] + 1)), lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(h, i + d) for d in mask]).alias("seed"), i.alias("at")))
        return F.when(n > mask[-1], made).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>"))

    return F.concat(*[of(k) for k in range(len(MASKS))])


def _items(bench: DataFrame) -> DataFrame:
    h = bench.select("item_id", _hashes(F.col("text")).alias("item"))
    return h.filter(F.size("item") > 0).select("item_id", "item", F.size("item").alias("size"), F.xxhash64("item").alias("name"))


def overlaps(spark: SparkSession, docs: DataFrame, bench: DataFrame, stretch: int = STRETCH, least: float = LEAST, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """doc_id, item_id, matched (most tokens that agree in one alignment), item_tokens, stretch_matched (most in a stretch): the pairs that overlap.

    Documents are read once for each block of seeds and never shuffled; only hits are. A seed is broadcast with its item's name, place and size alone; items meet their hits by a join.
    """
    items = _items(bench)
    shortest = min(m[-1] for m in MASKS) + 1
    long = items.filter(F.col("size") >= shortest)
    n_seeds = long.agg(F.sum("size") * len(MASKS)).first()[0] or 0
    blocks = max(1, -(-n_seeds // block_seeds))
    # explode of one array: a projection alone would be merged into the lambdas below, which would hash the whole text again at each token
    read = docs.select("doc_id", F.explode(F.array(_hashes(F.col("text")))).alias("h"))
    out = []
    for k in range(blocks):
        seeds = long.select("item_id", "name", "size", F.explode(_seeds(F.col("item"))).alias("s")).select("item_id", "name", "size", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
        seeds = seeds if blocks == 1 else seeds.filter(F.pmod("seed", F.lit(blocks)) == k)
        # the lambdas stay in a projection of their own: what follows up to the join is generated code, in which h is passed on and not copied
        placed = read.select("doc_id", "h", _seeds(F.col("h")).alias("s")).select("doc_id", "h", F.explode("s").alias("s")).select("doc_id", "h", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
        hits = placed.join(F.broadcast(seeds), "seed").withColumn("shift", F.col("at") - F.col("item_at"))
        under = F.slice("h", F.greatest("shift", F.lit(0)) + 1, F.col("size") + F.least("shift", F.lit(0)))
        out.append(hits.select("doc_id", F.xxhash64("h").alias("text"), "item_id", "name", "shift", under.alias("under")))
    # the hits of one alignment are one row, also those of several blocks; rows of one doc_id and different texts keep apart
    hits = reduce(DataFrame.unionByName, out).groupBy("doc_id", "text", "item_id", "name", "shift").agg(F.max_by("under", F.size("under")).alias("under"))
    its = long.select(F.col("item_id").alias("i"), F.col("name").alias("n"), "item").dropDuplicates(["i", "n"])
    hits = hits.join(its, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("name") == F.col("n")))
    found = [_judged(hits.select("doc_id", "item_id", "item", _laid(F.col("under"), F.col("item"), F.col("shift")).alias("laid")), stretch, least)]
    # items too short for a mask: as one run of tokens in the document's, tested for all documents with those items as a bounded literal set
    brief = items.filter(F.col("size") < shortest)
    if brief.limit(1).count():
        found.append(_brief(read, brief))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"), F.max("stretch_matched").alias("stretch_matched"))


def _laid(under: Column, item: Column, shift: Column) -> Column:
    """1 at each of the item's places whose token the document has at place + shift, else 0."""
    return F.transform(item, lambda t, i: F.coalesce((F.get(under, i + F.least(shift, F.lit(0))) == t).cast("int"), F.lit(0)))


def _judged(hits: DataFrame, stretch: int, least: float) -> DataFrame:
    n = F.size("item")
    width = F.least(n, F.lit(stretch))
    best = F.array_max(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.aggregate(F.slice("laid", i, width), F.lit(0), lambda a, x: a + x)))
    return hits.select("doc_id", "item_id", F.aggregate("laid", F.lit(0), lambda a, x: a + x).alias("matched"), n.alias("item_tokens"), best.alias("stretch_matched"), width.alias("width")).filter(F.col("stretch_matched") >= F.lit(least) * F.col("width")).drop("width")


def _brief(read: DataFrame, brief: DataFrame) -> DataFrame:
    """Short items: the seed is the whole item, at each of the lengths that occur (fewer than a mask's span)."""
    lengths = [r[0] for r in brief.select(F.size("item")).distinct().collect()]
    item = brief.select("item_id", F.size("item").alias("item_tokens"), F.xxhash64("item").alias("seed"))

    def runs(n: int) -> Column:
        return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(1), F.size("h") - (n - 1)), lambda i: F.xxhash64(F.slice("h", i, n)))).otherwise(F.array().cast("array<bigint>"))

    placed = read.select("doc_id", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("seed"))
    return placed.join(item, "seed").select("doc_id", "item_id", F.col("item_tokens").alias("matched"), "item_tokens", F.col("item_tokens").alias("stretch_matched"))


def clean(spark: SparkSession, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without those that overlap a benchmark item; rows of a null doc_id are judged by their text alone.

    Rows are keyed by a hash of their text, not by doc_id, so repeated ids of different texts keep apart.
    """
    key = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("doc_id"), "text")
    found = stored(spark, overlaps(spark, rows.select("doc_id", "text"), bench).select("doc_id").distinct(), "leaks")
    # a short list is sent to the documents, a long one is met by a shuffle
    small = found.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(found) if small else found, "doc_id", "left_anti").select("doc.*")


def _sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _sql_seeds(source: str, id_: str, h: str) -> str:
    """Seeds as text: the mask's number and the tokens that it reads."""
    one = lambda k, m: f"SELECT {id_}, pos, '{k} ' || " + " || ' ' || ".join(f"{h}[pos + {d + 1}]" for d in m) + f" AS seed FROM (SELECT {id_}, {h}, unnest(range(len({h}) - {m[-1]})) AS pos FROM {source} WHERE len({h}) > {m[-1]})"
    return " UNION ALL ".join(one(k, m) for k, m in enumerate(MASKS))


def oracle(stretch: int = STRETCH, least: float = LEAST) -> str:
    """overlaps() in DuckDB's SQL, over documents and benchmark of distinct ids."""
    shortest = min(m[-1] for m in MASKS) + 1
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {_sql_tokens("text")} AS h FROM documents),
b AS MATERIALIZED (SELECT item_id, item FROM (SELECT item_id, {_sql_tokens("text")} AS item FROM benchmark) WHERE len(item) > 0),
s AS MATERIALIZED (SELECT * FROM b WHERE len(item) >= {shortest}),
hits AS MATERIALIZED (SELECT DISTINCT x.doc_id, y.item_id, x.pos - y.pos AS shift FROM ({_sql_seeds("d", "doc_id", "h")}) x JOIN ({_sql_seeds("s", "item_id", "item")}) y USING (seed)),
laid AS (SELECT doc_id, item_id, list_transform(range(1, len(item) + 1), lambda i: CASE WHEN i + shift >= 1 AND i + shift <= len(h) AND h[i + shift] = item[i] THEN 1 ELSE 0 END) AS laid, least(len(item), {stretch}) AS width FROM hits JOIN d USING (doc_id) JOIN s USING (item_id)),
judged AS (SELECT doc_id, item_id, list_sum(laid) AS matched, len(laid) AS item_tokens, width, list_max(list_transform(range(1, len(laid) - width + 2), lambda i: list_sum(list_slice(laid, i, i + width - 1)))) AS stretch_matched FROM laid),
brief AS (SELECT doc_id, item_id, len(item) AS n FROM d, (SELECT * FROM b WHERE len(item) < {shortest}) WHERE contains(' ' || array_to_string(h, ' ') || ' ', ' ' || array_to_string(item, ' ') || ' '))
SELECT doc_id, item_id, CAST(max(matched) AS INTEGER) AS matched, CAST(max(item_tokens) AS INTEGER) AS item_tokens, CAST(max(stretch_matched) AS INTEGER) AS stretch_matched FROM (SELECT doc_id, item_id, matched, item_tokens, stretch_matched FROM judged WHERE stretch_matched >= {least} * width UNION ALL SELECT doc_id, item_id, n, n, n FROM brief) GROUP BY doc_id, item_id"""
