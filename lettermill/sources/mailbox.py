"""A mailbox export as a Spark data source, and folders of message files as a sink.

`mailbox`: a folder of files with one raw message a line (id, labelIds, snippet, payload); names that begin with _ or . are
passed over. Files are dealt out by byte ranges; rows are (id, unread, label_ids, raw, error). A line that can't be read is a row with an error: its id if one can be
made out, else `unknown`; it counts as unread, so that no scan loses it. A filter on `unread` reaches the reader. As a
stream, files follow one another by (time of writing, name); each batch takes all that are new.

`message_files`: one pretty-printed JSON file a message, named by its file_index, a manifest and a table of rows that have
an `error`. Tasks write into a folder of the run; only the commit gives it its name, so an aborted run leaves nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import folder

SCHEMA = "id string, unread boolean, label_ids array<string>, raw string, error string"
_ARROW = pa.schema([("id", pa.string()), ("unread", pa.bool_()), ("label_ids", pa.list_(pa.string())), ("raw", pa.string()), ("error", pa.string())])
#: Bytes of a partition, rows of a batch, and files of one batch of a stream at most (0: all).
PART_BYTES, BATCH = 64 << 20, 1000


def _plain(options: dict) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def message_row(line: bytes) -> dict:
    """The row of one line."""
    text = line.decode("utf-8", "replace")
    try:
        got = json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("no object")
        labels = got.get("labelIds") or []
        return {"id": got.get("id") or "unknown", "unread": "UNREAD" in labels, "label_ids": labels, "raw": text, "error": None}
    except (ValueError, TypeError) as e:
        named = re.search(r'"id"\s*:\s*"([^"\\]+)"', text)
        return {"id": named[1] if named else "unknown", "unread": True, "label_ids": [], "raw": None, "error": f"Unknown error: {type(e).__name__}"}


def _lines(uri: str, part: Range) -> Iterator[bytes]:
    """Lines that begin in the range: a range that begins within a line leaves it to the one before."""
    files, _ = folder(uri)
    with files.open_input_file(part.path) as f:
        f.seek(max(0, part.start - 1))
        rest, at = b"", f.tell()
        skip = part.start > 0
        while True:
            block = f.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                elif begin >= part.stop:
                    return
                elif line.strip():
                    yield line
            if not block:
                return


def _listed(uri: str) -> list[afs.FileInfo]:
    files, at = folder(uri)
    found = files.get_file_info(afs.FileSelector(at, allow_not_found=True))
    return [x for x in found if x.type == afs.FileType.File and x.base_name[:1] not in "_."]


def _ranges(found: list[afs.FileInfo], size: int) -> list[Range]:
    return [Range(x.path, k, min(k + size, x.size)) for x in sorted(found, key=lambda x: x.path) for k in range(0, x.size, size)]


class _Rows:
    def __init__(self, options: dict, unread: bool | None = None) -> None:
        self.uri, self.size, self.unread = options["path"], int(options.get("partbytes", PART_BYTES)), unread

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        batch: list[dict] = []
        if partition is None:  # an empty mailbox
            return
        for line in _lines(self.uri, partition):
            # a message that is not asked for is not kept
            row = message_row(line)
            if self.unread is None or row["unread"] == self.unread:
                batch.append(row)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_pylist(batch, _ARROW)
                batch = []
        if batch:
            yield pa.RecordBatch.from_pylist(batch, _ARROW)


class _Reader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("unread",) and isinstance(f.value, bool) and self.unread in (None, f.value):
                self.unread = f.value
            elif isinstance(f, IsNotNull) and f.attribute == ("unread",):
                pass  # it never is
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        return _ranges(_listed(self.uri), self.size)


class _Stream(_Rows, DataSourceStreamReader):
    """Offsets are the (time, name) of the last file taken."""

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        newest = max(((x.mtime_ns, x.path) for x in _listed(self.uri)), default=(0, ""))
        return {"time": newest[0], "name": newest[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        lo, hi = ((o["time"], o["name"]) for o in (start, end))
        return _ranges([x for x in _listed(self.uri) if lo < (x.mtime_ns, x.path) <= hi], self.size)


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_plain(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_plain(self.options))


# --- message files ---
@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int
    errors: int
    first: int


_FLAGS = ("snippet", "from", "to", "sent", "body")


class _Writer(DataSourceArrowWriter):
    """Files of a run go to `<path>.run-<id>`; committing it names it `path`."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.uri, self.overwrite = options["path"].rstrip("/"), overwrite
        self.created = options.get("createdat") or datetime.now(timezone.utc).isoformat()
        self.run = f"{self.uri}.run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, at = folder(self.run)
        for sub in ("", "/manifest", "/errors"):
            files.create_dir(at + sub, recursive=True)
        part, entries, errors, first = uuid.uuid4().hex, [], [], None
        for batch in iterator:
            for row in batch.to_pylist():
                first = row["file_index"] if first is None else min(first, row["file_index"])
                if row.get("error") is not None:
                    errors.append({"file_index": row["file_index"], "id": row["id"], "error": row["error"]})
                    continue
                name = f"email_{row['file_index']:03d}.json"
                shown = {k: v for k, v in row.items() if k not in ("error", "filename")}
                with files.open_output_stream(f"{at}/{name}") as f:
                    f.write(json.dumps(shown, ensure_ascii=False, indent=2, default=str).encode())
                entries.append({"file_index": row["file_index"], "filename": name, "id": row["id"], "subject": row["subject"], **{f"has_{c}": row[c] is not None for c in _FLAGS}})
        for kind, rows in (("manifest", entries), ("errors", errors)):
            if rows:
                with files.open_output_stream(f"{at}/{kind}/{part}.jsonl") as f:
                    f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode())
        return Written(part, len(entries), len(errors), first or 0)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = folder(self.run)
        _, target = folder(self.uri)
        if files.get_file_info(target).type != afs.FileType.NotFound:
            if not self.overwrite:
                files.delete_dir(at)
                raise FileExistsError(self.uri)
            files.delete_dir(target)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        files.create_dir(at, recursive=True)
        manifest = {"created_at": self.created, "total_emails": sum(m.rows for m in done), "errors": sum(m.errors for m in done), "parts": [f"manifest/{m.part}.jsonl" for m in done if m.rows]}
        with files.open_output_stream(f"{at}/manifest.json") as f:
            f.write(json.dumps(manifest, indent=2).encode())
        files.move(at, target)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = folder(self.run)
        if files.get_file_info(at).type != afs.FileType.NotFound:
            files.delete_dir(at)


class MessageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        raise NotImplementedError("message_files is written; mail.read_json reads it")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_plain(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Both formats for the session. Filters reach Python sources only where spark.sql.python.filterPushdown.enabled is true, which this sets where it is unset."""
    spark.dataSource.register(Mailbox)
    spark.dataSource.register(MessageFiles)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def export(messages: DataFrame, path: str, labels: list[str] | None = None, cut: Column | None = None) -> None:
    """messages (MESSAGE, and label_ids if it has them) as a mailbox export. cut: of which rows half the line is lost, for tests of readers."""
    header = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), c.alias("value")))
    headers = F.array_compact(F.array(header("Subject", F.col("subject")), header("From", F.col("from")), header("To", F.array_join("to", ", ")), header("Date", F.col("sent"))))
    ids = F.col("label_ids") if "label_ids" in messages.columns else F.array(*map(F.lit, labels or [])).cast("array<string>")
    whole = F.struct("id", ids.alias("labelIds"), "snippet", F.struct(headers.alias("headers"), F.struct(F.col("body").alias("data")).alias("body")).alias("payload"))
    line = F.to_json(whole)
    line = line if cut is None else F.when(cut, F.substring(line, F.lit(1), F.least(F.floor(F.length(line) / 2), F.lit(40)).cast("int"))).otherwise(line)
    messages.select(line.alias("value")).write.option("lineSep", "\n").format("text").save(path)


def unread(spark: SparkSession, path: str, most: int | None = 5) -> DataFrame:
    """Unread messages, five by default: the limit is the feature (None: all)."""
    df = spark.read.format("mailbox").load(path).filter("unread = true")
    return df if most is None else df.orderBy("id").limit(most)


def inbox(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Messages of any label, 100 at most."""
    return spark.read.format("mailbox").load(path).orderBy("id").limit(min(most, 100))
