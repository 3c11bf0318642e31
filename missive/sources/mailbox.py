"""A mailbox of message files as a data source: ``spark.read``, ``readStream`` and ``write`` with format ``mailbox``.

Files lie at ``<root>/<folder>/<uid div 1000>/<uid>.eml``, folders percent-encoded.  Options say what is wanted: ``low`` and ``high`` for a range of
uids, ``uids`` and ``names`` (JSON lists) for some uids and folders.  The driver lists folders and blocks of uids that can match, never
files, and tasks list and open what is in these blocks.  With ``content`` set to ``false`` sizes come from listings and no file
is opened.  A task reads ``blocks`` blocks (16), newest first, in batches of bounded size.

Conditions of a query are not pushed down: Spark 4.1 keeps those of a Python source with the source and not with the scan, so
scans of one DataFrame under different conditions would get each other's rows (test_mailbox.py has such a union).

A stream goes on from the largest uid of each folder, found in its newest block, so looking for news costs no more as a mailbox
grows.  Uids rise, as in any mailbox: a message filed later under a uid below the last one is not news.  A
folder that goes and comes again is a new one.  A file that goes while it is read is
no row; a missing root is an error, an empty one has no rows.  Names other than a uid's are ignored, and so are unfinished files.

Any file system that pyarrow knows will do; a path without a scheme is local to each machine.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Uids of a directory; rows and bytes of a batch.
BLOCK, ROWS, BYTES = 1000, 256, 32 << 20
LARGEST = 2**63 - 1
SCHEMA = "raw_name string, uid long, size_bytes long, modified timestamp"
_FILE = re.compile(r"(\d{1,18})\.eml")
_BLOCK = re.compile(r"\d{1,16}")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, at = fs.FileSystem.from_uri(path)
    return system, at.rstrip("/")


def folder_name(raw_name: str) -> str:
    """A folder's directory: never empty, hidden, or a way out of the root."""
    if not raw_name:
        raise ValueError("a folder has a name")
    name = quote(raw_name, safe=" ")
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


def directories(system: fs.FileSystem, path: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith((".", "_"))]


def blocks_of(system: fs.FileSystem, path: str) -> list[int]:
    """Newest first."""
    return sorted((int(b) for b in directories(system, path) if _BLOCK.fullmatch(b)), reverse=True)


@dataclass
class Wanted:
    """Uids from ``low`` to ``high``, of ``uids`` and ``names`` alone if given."""

    low: int = 1
    high: int = LARGEST
    uids: frozenset[int] | None = None
    names: frozenset[str] | None = None

    def has(self, uid: int) -> bool:
        return self.low <= uid <= self.high and (self.uids is None or uid in self.uids)

    def has_block(self, block: int) -> bool:
        inside = self.low // BLOCK <= block <= self.high // BLOCK
        return inside and (self.uids is None or any(u // BLOCK == block for u in self.uids))


@dataclass
class Blocks(InputPartition):
    """Some of a folder's blocks, and what is wanted of them."""

    folder: str
    blocks: list[int]
    wanted: Wanted = field(default_factory=Wanted)


class _Files:
    """Listing in the driver and reading in tasks, for batches and streams alike."""

    def __init__(self, path: str, content: bool, blocks: int):
        self.path, self.content, self.per_task = path, content, blocks

    def folders(self) -> dict[str, str]:
        """Directories and the folders' names."""
        system, root = opened(self.path)
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"there is no mailbox at {self.path}")
        return {d: unquote(d) for d in sorted(directories(system, root))}

    def plan(self, wanted: dict[str, Wanted]) -> list[Blocks]:
        """Tasks for directories and what is wanted of each."""
        system, root = opened(self.path)
        out = []
        for d, w in wanted.items():
            mine = [b for b in blocks_of(system, f"{root}/{d}") if w.has_block(b)]
            out += [Blocks(d, mine[i : i + self.per_task], w) for i in range(0, len(mine), self.per_task)]
        return out

    def rows(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        name, rows, held = unquote(part.folder), [], 0
        for b in part.blocks:
            found = system.get_file_info(fs.FileSelector(f"{root}/{part.folder}/{b}", allow_not_found=True))
            named = ((_FILE.fullmatch(f.base_name), f) for f in found if f.type == fs.FileType.File)
            mine = [(int(m[1]), f) for m, f in named if m and int(m[1]) // BLOCK == b and part.wanted.has(int(m[1]))]
            for uid, f in sorted(mine, key=lambda x: -x[0]):
                row = [name, uid, f.size, f.mtime]
                if self.content:
                    if rows and held + f.size > BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
                    try:
                        with system.open_input_stream(f.path) as stream:
                            row.append(stream.read())
                    except FileNotFoundError:
                        continue
                    row[2] = len(row[4])
                    held += row[2]
                rows.append(row)
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        kinds = [("raw_name", pa.string()), ("uid", pa.int64()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))]
        kinds += [("content", pa.binary())] * self.content
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


class MailboxReader(DataSourceReader):
    def __init__(self, files: _Files, wanted: Wanted):
        self.files, self.wanted = files, wanted

    def partitions(self) -> Sequence[InputPartition]:
        w = self.wanted
        # With nothing to read Spark would ask for the default, one partition without a description.
        found = self.files.plan({d: w for d, name in self.files.folders().items() if w.names is None or name in w.names})
        return found or [Blocks("", [])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class MailboxStream(DataSourceStreamReader):
    """Offsets are the largest uid of each directory."""

    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = opened(self.files.path)
        out = {}
        for d in self.files.folders():
            for b in blocks_of(system, f"{root}/{d}"):
                names = (_FILE.fullmatch(f.base_name) for f in system.get_file_info(fs.FileSelector(f"{root}/{d}/{b}", allow_not_found=True)))
                if uids := [int(m[1]) for m in names if m and int(m[1]) // BLOCK == b]:
                    out[d] = max(uids)
                    break
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        news = {d: Wanted(start.get(d, 0) + 1, top) for d, top in end.items() if top > start.get(d, 0)}
        return self.files.plan(news)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class MailboxWriter(DataSourceArrowWriter):
    """Each row becomes a file, by a renamed temporary one: readers see all of a message or nothing, and a task that runs
    again writes the same files."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        made = set()
        for batch in iterator:
            for name, uid, content in zip(*(batch.column(c) for c in ("raw_name", "uid", "content")), strict=True):
                uid = uid.as_py()
                if uid is None or uid < 1 or uid >= 10**18 or name.as_py() is None:
                    raise ValueError(f"a message needs a folder and a uid from 1 on: {name.as_py()!r}, {uid}")
                at = f"{root}/{folder_name(name.as_py())}/{uid // BLOCK}"
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                unfinished = f"{at}/.{uid}-{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as out:
                    out.write(content.as_py() or b"")
                system.move(unfinished, f"{at}/{uid}.eml")
        return WriterCommitMessage()


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def _files(self) -> _Files:
        return _Files(self.options["path"], self._content(), int(self.options.get("blocks", "16")))

    def _content(self) -> bool:
        return self.options.get("content", "true").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self._content() else "")

    def reader(self, schema) -> MailboxReader:
        some = lambda name: frozenset(json.loads(self.options[name])) if name in self.options else None
        wanted = Wanted(int(self.options.get("low", "1")), int(self.options.get("high", str(LARGEST))), some("uids"), some("names"))
        return MailboxReader(self._files(), wanted)

    def streamReader(self, schema) -> MailboxStream:
        return MailboxStream(self._files())

    def writer(self, schema, overwrite: bool) -> MailboxWriter:
        if overwrite:
            raise ValueError("a mailbox is appended to")
        return MailboxWriter(self.options["path"])


def read(
    spark: SparkSession, root: str, content: bool = True, low: int = 1, high: int | None = None, uids: Iterable[int] | None = None, names: Iterable[str] | None = None
) -> DataFrame:
    """The messages with uids from ``low`` to ``high``, of ``uids`` and in folders ``names`` alone if given."""
    spark.dataSource.register(Mailbox)
    options = {"content": str(content).lower(), "low": low} | ({} if high is None else {"high": high})
    options |= {k: json.dumps(list(v)) for k, v in (("uids", uids), ("names", names)) if v is not None}
    return spark.read.format("mailbox").options(**options).load(root)


def follow(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """A stream of what is new."""
    spark.dataSource.register(Mailbox)
    return spark.readStream.format("mailbox").option("content", str(content).lower()).load(root)


def write(rows: DataFrame, root: str) -> None:
    """File ``rows(raw_name, uid, content)``, each folder and uid once; null content is an empty file."""
    rows.sparkSession.dataSource.register(Mailbox)
    rows.selectExpr("raw_name", "CAST(uid AS long) AS uid", "CAST(content AS binary) AS content").write.format("mailbox").mode("append").save(root)
