"""Known originals in texts: every place of each, by automata over blocks of the dictionary.

The dictionary may be of any size. It is cut by a hash into blocks of about BLOCK_BYTES, each of which is collected, sent
to the tasks and made into one Aho-Corasick automaton a worker; texts are read once for each block. A text that has a
million places has a million rows, which leave its task batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import stored

BLOCK_BYTES, BATCH = 32 << 20, 10_000


def _automaton(words: list[tuple[str, str]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for text, kind in words:
        made.add_word(text, (text, kind))
    made.make_automaton()
    return made


def occurrences(df: DataFrame, known: DataFrame, key: str, column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, pii_type, text, start, end (characters) of every place of every text of known (text, pii_type) in the column, places that overlap included.

    Null and empty texts have none, in either table; of two types of one text the least counts; repeated rows of df count each.
    """
    words = stored(known.filter("text != ''").groupBy("text").agg(F.min("pii_type").alias("pii_type")), "known")
    size = words.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    context = df.sparkSession.sparkContext
    out = T.StructType([df.schema[key], T.StructField("pii_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = {"pii_type": pa.string(), "text": pa.string(), "start": pa.int64(), "end": pa.int64()}

    def scan(block: int) -> DataFrame:
        rows = words.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).select("text", "pii_type").collect()
        sent = context.broadcast([(r.text, r.pii_type) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for b in batches:
                if not sent.value:
                    return
                automaton = automaton or _automaton(sent.value)
                at: list[int] = []
                found: dict[str, list] = {c: [] for c in arrow}

                def made() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(found[c], t) for c, t in arrow.items()]], [key, *arrow])  # noqa: B023

                for k, text in enumerate(b.column(1).to_pylist()):
                    for last, (word, kind) in automaton.iter(text) if text else ():
                        at.append(k)
                        for c, v in zip(arrow, (kind, word, last + 1 - len(word), last + 1), strict=True):
                            found[c].append(v)
                        if len(at) == BATCH:
                            yield made()
                            at, found = [], {c: [] for c in arrow}
                if at:
                    yield made()

        return df.select(F.col(key), F.col(column).alias("_text")).mapInArrow(run, out)

    found = scan(0)
    for block in range(1, blocks):
        found = found.unionByName(scan(block))
    return found
