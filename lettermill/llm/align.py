"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often each pair does.

A text's tokens in both vocabularies are laid over its bytes; offsets where a token of either ends cut them into
groups, and the two tokens that end there are linked. Pairs are counted over the whole corpus as packed int64 keys
(b << 32 | a): each partition counts its own with np.unique, the partial counts are sorted by ranges of the key and
runs of one key are summed on the way through, each range writes a sorted shard (keys and counts) into the shared
folder, and lookups search the shards, which are mapped and not read. A key has one row for each task that met it,
so no pair, however common, is a large group. The greatest count of each b is one number for each id of the vocabulary:
all that the driver collects and broadcasts, besides the shards' names.

Defined results: a text that is null or empty, or whose joined tokens are not the space and the text, has no tokens and
zeros; repeated rows count each; a pair's ties share the highest count; an empty table gives no rows; extra
columns are ignored; strings of special tokens are plain text. A text is encoded whole, so a worker has to hold its
tokens (some 30 bytes for each byte of the longest text).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored, tune
from .packing import ByteBpe

#: Distinct pairs that a task holds before it hands on what it has counted.
HELD = 4 << 20


class PlainBpe(ByteBpe):
    """Byte-level ids; the strings of added tokens are text."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        super().__init__(json_path, ranks_path, pattern)
        self.exact.encode_special_tokens = True
        self.added = []

    def pieces(self) -> list[bytes]:
        """Bytes of each id: printable Latin-1 stands for itself in the file, every other byte for a character from 256 up, in order."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
        return [bytes(byte[c] for c in self.exact.id_to_token(i)) if all(c in byte for c in self.exact.id_to_token(i)) else self.exact.id_to_token(i).encode() for i in range(self.exact.get_vocab_size())]

    def encode(self, text: str) -> list[int]:
        return self(" " + text)


class Pieces:
    """Ids of a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def pieces(self) -> list[bytes]:
        m = self.model
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("\u2581", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def default_pair() -> tuple[PlainBpe, Pieces]:
    import public_tokenizers as files

    return PlainBpe(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN), Pieces(files.path("piece_bpe_32k.model"))


class Aligner:
    """Both vocabularies' bytes, and their ids as text with each sign that may follow."""

    def __init__(self, pair: tuple) -> None:
        self.a, self.b = pair
        self.bytes_a, self.bytes_b = self.a.pieces(), self.b.pieces()
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.na, self.nb = len(self.bytes_a), len(self.bytes_b)
        self.kind = "<u2" if max(self.na, self.nb) <= 65536 else "<u4"
        # after a token that does not end its group a comma; after the last of A's a bar, of B's a semicolon
        self.signs = [b"%d%s" % (i, s) for n, signs in ((self.na, (b",", b"|")), (self.nb, (b",", b";"))) for s in signs for i in range(n)]

    def __call__(self, text: str) -> tuple[int, int, int, str, bytes] | None:
        """n_a, n_b, n_groups, the groups' text and the linked ids (all of A's, then all of B's); None for a text without tokens."""
        if not text:
            return None
        ids_a, ids_b, whole = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # offsets grow by a byte at least, so each common one ends one token of either
        marks = np.zeros(len(whole) + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        common = np.flatnonzero(marks == 3)
        both_a, both_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        last_a, last_b = (np.zeros(len(x), bool) for x in (a, b))
        last_a[both_a], last_b[both_b] = True, True
        # a token's place in the text of all groups: after its own side's earlier tokens and the other side's of earlier groups
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], both_b + 1])[group_a]] = a + last_a * self.na
        order[np.arange(len(b)) + (both_a + 1)[group_b]] = b + last_b * self.nb + 2 * self.na
        said = b"".join(map(self.signs.__getitem__, order.tolist()))[:-1].decode()
        return len(a), len(b), len(common), said, a[both_a].astype(self.kind).tobytes() + b[both_b].astype(self.kind).tobytes()


def linked(blob: bytes, n: int) -> np.ndarray:
    """Packed keys of n links."""
    ids = np.frombuffer(blob, f"<u{len(blob) // (2 * n)}" if n else "<u2").astype(np.int64)
    return ids[n:] << 32 | ids[:n]


def tokenised(docs: DataFrame, make: Callable[[], tuple] = default_pair, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (ids of A, then of B), and, with_groups, groups (`a1,a2|b1;a3|b2,b3`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(make())
        for batch in batches:
            got = [aligner(t) if t else None for t in batch.column("text").to_pylist()]
            n = [pa.array([g[k] if g else 0 for g in got], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(g[3].encode()).hexdigest() if g else "" for g in got], pa.string())
            more = [pa.array([g[3] if g else "" for g in got], pa.string())] if with_groups else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, sha, pa.array([g[4] if g else b"" for g in got], pa.binary()), *more], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", *(["groups"] if with_groups else [])])

    long, text = T.LongType(), T.StringType()
    out = T.StructType([docs.schema["doc_id"], *[T.StructField(c, long) for c in ("n_a", "n_b", "n_groups")], T.StructField("groups_sha256", text), T.StructField("links", T.BinaryType()), *([T.StructField("groups", text)] if with_groups else [])])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    distinct, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    return distinct, total


def partial_counts(links: DataFrame) -> DataFrame:
    """key, n: pairs counted within each task, in batches; a task that has met HELD distinct ones hands them on and goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            got = [linked(x, n) for x, n in zip(batch.column("links").to_pylist(), batch.column("n_groups").to_pylist(), strict=True) if n]
            if got:
                key, n = np.unique(np.concatenate(got), return_counts=True)
                keys.append(key)
                counts.append(n.astype(np.int64))
            if sum(map(len, keys)) > HELD:
                key, n = _summed(keys, counts)
                keys, counts = [key], [n]
                if len(key) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
                    keys, counts = [], []
        if keys:
            key, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return links.select("n_groups", "links").mapInArrow(run, "key long, n long")


def _folder(uri: str) -> tuple[afs.FileSystem, str]:
    """A folder's file system and its path there; s3a is s3 to Arrow."""
    return afs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1)) if urlparse(uri).scheme else (afs.LocalFileSystem(), uri)


def write_shards(spark: SparkSession, partial: DataFrame) -> DataFrame:
    """Sums partial counts into sorted shards in the shared folder: name, first, rows, b and most (the greatest count of each b in the shard).

    A task's shard has a name of its own; of tasks that are tried twice only the one that Spark commits is named in the table.
    """
    uri = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _folder(uri)
        name, key, n = uuid.uuid4().hex, np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, first, most, out = 0, None, {}, None

        def put(key: np.ndarray, n: np.ndarray) -> None:
            nonlocal rows, first, out
            if out is None:
                files.create_dir(at, recursive=True)
                out = [files.open_output_stream(f"{at}/{name}.{x}") for x in ("keys", "counts")]
                first = int(key[0])
            out[0].write(key.astype("<i8").tobytes())
            out[1].write(n.astype("<i8").tobytes())
            rows += len(key)
            b, start = np.unique(key >> 32, return_index=True)
            for i, x in zip(b.tolist(), np.maximum.reduceat(n, start).tolist(), strict=True):
                most[i] = max(x, most.get(i, 0))

        for batch in batches:
            if batch.num_rows:
                key, n = _summed([key, batch.column("key").to_numpy()], [n, batch.column("n").to_numpy()])
                # the last run may go on in the next batch
                if len(key) > 1:
                    put(key[:-1], n[:-1])
                    key, n = key[-1:], n[-1:]
        if len(key):
            put(key, n)
            for f in out:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([rows]), pa.array([list(most)], pa.list_(pa.int64())), pa.array([list(most.values())], pa.list_(pa.int64()))], ["name", "first", "rows", "b", "most"])

    sorted_ = partial.repartitionByRange("key").sortWithinPartitions("key")
    return stored(spark, sorted_.mapInArrow(run, "name string, first long, rows long, b array<long>, most array<long>").withColumn("folder", F.lit(uri)), "shards")


class Counts:
    """Counts of pairs from sorted shards, opened when a key first falls in them: mapped where the folder is mounted, else read."""

    def __init__(self, folder: str, names: list[str], first: np.ndarray, most: np.ndarray) -> None:
        self.folder, self.names, self.first, self.most, self.open = folder, names, first, most, {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            files, at = _folder(self.folder)
            if isinstance(files, afs.LocalFileSystem):
                self.open[k] = tuple(np.memmap(f"{at}/{self.names[k]}.{x}", "<i8", "r") for x in ("keys", "counts"))
            else:
                self.open[k] = tuple(np.frombuffer(files.open_input_file(f"{at}/{self.names[k]}.{x}").read_buffer(), "<i8") for x in ("keys", "counts"))
        return self.open[k]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, all of which occur."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.first), len(keys))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(cuts[k], cuts[k + 1])
            known, n = self._shard(k)
            out[part] = n[np.searchsorted(known, keys[part])]
        return out


def counts(spark: SparkSession, shards: DataFrame, vocabulary: int) -> Counts:
    """The lookup over written shards; `vocabulary`: ids of B, which bounds what is collected."""
    got = sorted(shards.select("name", "first", "folder").collect(), key=lambda r: r.first)
    most = np.zeros(vocabulary, np.int64)
    for r in shards.select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("most")).collect():
        most[r.b] = r.most
    return Counts(got[0].folder if got else "", [r.name for r in got], np.array([r.first for r in got], np.int64), most)


def pair_table(spark: SparkSession, docs: DataFrame, make: Callable[[], tuple] = default_pair) -> DataFrame:
    """a, b, n: how often each pair of ids is linked in all documents."""
    tune(spark)
    summed = partial_counts(stored(spark, tokenised(docs, make), "links")).groupBy("key").agg(F.sum("n").alias("n"))
    return summed.select(F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("a"), F.shiftright("key", 32).alias("b"), "n")


def align(spark: SparkSession, docs: DataFrame, make: Callable[[], tuple] = default_pair, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with_groups, groups. Texts are encoded once."""
    tune(spark)
    links = stored(spark, tokenised(docs, make, with_groups), "links")
    found = spark.sparkContext.broadcast(counts(spark, write_shards(spark, partial_counts(links)), len(make()[1].pieces())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Counts(found.value.folder, found.value.names, found.value.first, found.value.most)
        for batch in batches:
            sizes = batch.column("n_groups").to_numpy()
            keys = np.concatenate([np.zeros(0, np.int64), *[linked(x, n) for x, n in zip(batch.column("links").to_pylist(), sizes.tolist(), strict=True) if n]])
            distinct, at = np.unique(keys, return_inverse=True)
            n = lookup(distinct)
            best = n == lookup.most[distinct >> 32]
            ends = np.cumsum(sizes)
            over = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at])])[np.concatenate([[0], ends])]).astype(np.int64))  # noqa: B023, E731
            columns = {"doc_id": batch.column("doc_id"), "n_a": batch.column("n_a"), "n_b": batch.column("n_b"), "n_groups": batch.column("n_groups"), "n_links": batch.column("n_groups"), "n_best": over(best), "count_sum": over(n), "groups_sha256": batch.column("groups_sha256")}
            yield pa.RecordBatch.from_pydict(columns | ({"groups": batch.column("groups")} if with_groups else {}))

    long, text = T.LongType(), T.StringType()
    out = T.StructType([docs.schema["doc_id"], *[T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", text), *([T.StructField("groups", text)] if with_groups else [])])
    return links.mapInArrow(run, out)
