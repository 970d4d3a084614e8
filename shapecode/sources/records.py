"""Fixed-length binary records as a splittable data source.

``spark.read.format("fixed_records")`` cuts files into byte ranges that hold
whole records, so one large recording is decoded by many tasks; small files
are gathered until a range is full.  A task reads its range and decodes it as
whole columns (numpy on the bytes, Arrow batches out); nothing runs per record.

Options: ``path`` (a file, a folder or a pattern without ``**``), ``layout``
(``212``, ``le16``, ``apnea`` or ``raw``), ``record_bytes`` (``raw`` only),
``split_bytes`` (target size of a range), ``tail`` (``report``: rows of whole
records only; ``error``: a file with a partial last record fails the read).
Columns: ``path``, ``i`` (record number, continued from the number in the
file's name ``part-<first>-...``, else from 0) and the layout's own.
:func:`partial_tails` lists what a file holds beyond its whole records.

``df.write.format("fixed_records")`` takes ``(source_id, i0, content)`` rows
and writes ``source_id=<id>/part-<i0>-<uuid>.dat`` files; rows of a source that
follow each other in a task continue one file.  Files are written under hidden
names and renamed when the whole job commits, so a reader never sees the files
of failed or repeated tasks.

``spark.readStream.format("fixed_records")`` follows recordings that grow (S1):
an offset is the number of whole records read of every file, so a restart goes
on where the last committed batch ended.  ``starting`` (``earliest`` or
``latest``) says where a new query begins, ``max_records`` how many records a
batch may take (the first batch after a restart takes what is there).  With
``frame_len`` a record is a whole frame of samples (channel 1 of ``212``):
columns ``path``, ``i`` (frame number) and ``frame``.

Files are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS URIs); for other
stores ``sources.binary`` reads whole files through Spark.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition,
                                    WriterCommitMessage)

SPLIT_BYTES = 32 << 20
BATCH_RECORDS = 1 << 16
RANGE_FILES = 512           # most files that one task of a stream's batch opens
TAIL = ("report", "error")


# ------------------------------------------------------------------ layouts

def _columns_212(b: np.ndarray) -> list[np.ndarray]:
    b = b.astype(np.int32)
    return [((b[:, 1] & 0x0F) << 8) + b[:, 0], ((b[:, 1] & 0xF0) << 4) + b[:, 2]]


def _columns_le16(b: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(b).view("<i2")[:, 0].astype(np.int32)]


def _columns_apnea(b: np.ndarray) -> list[np.ndarray]:
    return [b[:, 1].astype(np.int32)]


# layout -> (bytes of a record, columns, decoder of an (n, bytes) array)
LAYOUTS = {"212": (3, ("s1 int", "s2 int"), _columns_212), "le16": (2, ("raw int",), _columns_le16), "apnea": (8, ("mark int",), _columns_apnea)}


def _layout(options) -> tuple[int, tuple[str, ...], object]:
    """(bytes of a record, columns, decoder); with ``frame_len`` the samples of a record are one array."""
    name = options.get("layout", "raw")
    if name in LAYOUTS:
        size, names, decode = LAYOUTS[name]
        n = int(options.get("frame_len", 0))
        if not n:
            return size, names, decode

        def frames(b: np.ndarray) -> list:
            first = decode(b.reshape(-1, size))[0]
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(first) + 1, n, dtype=np.int32)), pa.array(first, pa.int32()))]
        return size * n, ("frame array<int>",), frames
    if name != "raw":
        raise ValueError(f"layout must be raw or one of {sorted(LAYOUTS)}")
    return int(options["record_bytes"]), ("record binary",), None


# ------------------------------------------------------------------ files

def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _visible(path: str, root: str) -> bool:
    return not any(p.startswith(("_", ".")) for p in path[len(root) :].strip("/").split("/"))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the visible files below a folder, of one file, or of a pattern's matches, in order of path."""
    from fnmatch import fnmatch

    from pyarrow import fs
    system, at = _open(path)
    if any(c in at for c in "*?["):
        root = at[: re.search(r"[*?\[]", at).start()].rpartition("/")[0]
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if fnmatch(f.path, at)]
    else:
        info, root = system.get_file_info(at), at
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and (f.path == root or _visible(f.path, root)))


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, offset, bytes) that one task reads."""
    parts: list[tuple[str, int, int]] = field(default_factory=list)

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


def ranges(files: list[tuple[str, int]], record: int, split_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Byte ranges of whole records, gathered to about ``split_bytes`` each."""
    step = max(1, split_bytes // record) * record
    out: list[list[tuple[str, int, int]]] = []
    now: list[tuple[str, int, int]] = []
    size = 0
    for path, length in files:
        whole = length // record * record
        for at in range(0, whole, step):
            n = min(step, whole - at)
            if now and size + n > step:
                out.append(now)
                now, size = [], 0
            now.append((path, at, n))
            size += n
    return out + [now] * bool(now)


def first_record(path: str) -> int:
    m = re.match(r"part-(\d+)-", posixpath.basename(path))
    return int(m[1]) if m else 0


# ------------------------------------------------------------------ reader

class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.record, self.names, self.decode = _layout(options)
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tail = options.get("tail", "report")
        if self.tail not in TAIL:
            raise ValueError(f"tail must be one of {TAIL}")

    def partitions(self):
        files = list_files(self.path)
        if self.tail == "error":
            bad = [(p, n % self.record) for p, n in files if n % self.record]
            if bad:
                raise ValueError(f"{len(bad)} files end in a partial record, for example {bad[0][0]} ({bad[0][1]} bytes)")
        return [Ranges(r) for r in ranges(files, self.record, self.split)] or [Ranges([])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for path, at, length in partition.parts:
            system, _ = _open(self.path)
            first = first_record(path) + at // self.record
            with system.open_input_file(path) as f:
                f.seek(at)
                left = length
                while left:
                    data = f.read(min(left, BATCH_RECORDS * self.record))
                    if not data or len(data) % self.record:
                        raise OSError(f"{path} is shorter than when it was listed")
                    left -= len(data)
                    yield self._batch(path, first, np.frombuffer(data, dtype=np.uint8).reshape(-1, self.record))
                    first += len(data) // self.record

    def _batch(self, path, first, b) -> pa.RecordBatch:
        n = len(b)
        if self.decode:
            own = [c if isinstance(c, pa.Array) else pa.array(c, pa.int32()) for c in self.decode(b)]
        else:
            off = pa.array(np.arange(0, (n + 1) * self.record, self.record, dtype=np.int32))
            own = [pa.Array.from_buffers(pa.binary(), n, [None, off.buffers()[1], pa.py_buffer(np.ascontiguousarray(b))])]
        names = ["path", "i", *[x.split()[0] for x in self.names]]
        return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, dtype=np.int32))),
                                           pa.array(np.arange(first, first + n, dtype=np.int64)), *own], names=names)


class RecordStreamReader(DataSourceStreamReader):
    """Whole records that files have gained; offsets are ``{"files": {path: records}}``."""

    def __init__(self, options):
        self.reader = RecordReader(options)
        self.starting = options.get("starting", "earliest")
        if self.starting not in ("earliest", "latest"):
            raise ValueError("starting must be earliest or latest")
        self.most = int(options.get("max_records", 0))
        self.position: dict[str, int] | None = None

    def _there(self) -> dict[str, int]:
        try:
            return {p: n // self.reader.record for p, n in list_files(self.reader.path)}
        except FileNotFoundError:
            return {}

    def initialOffset(self) -> dict:
        self.position = self._there() if self.starting == "latest" else {}
        return {"files": self.position}

    def latestOffset(self) -> dict:
        there, known = self._there(), self.position
        if known is not None:
            left, now = self.most or None, dict(known)          # a file that vanished or shrank keeps its place
            for path, n in there.items():
                more = max(0, n - known.get(path, 0))
                take = more if left is None else min(left, more)
                if take:
                    now[path] = known.get(path, 0) + take
                    left = None if left is None else left - take
            there = now
        self.position = there
        return {"files": there}

    def partitions(self, start: dict, end: dict):
        self.position = dict(end["files"])
        size = self.reader.record
        step = max(1, self.reader.split // size)
        out, now, held = [], [], 0
        for path, stop in sorted(end["files"].items()):
            for at in range(start["files"].get(path, 0), stop, step):
                n = min(step, stop - at)
                if now and (held + n > step or len(now) == RANGE_FILES):
                    out.append(Ranges(now))
                    now, held = [], 0
                now.append((path, at * size, n * size))
                held += n
        return out + [Ranges(now)] * bool(now)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


# ------------------------------------------------------------------ writer

@dataclass
class Written(WriterCommitMessage):
    files: list[str]           # final paths below the root; a file is hidden (a dot before its name) until the commit


def _hidden(path: str) -> str:
    folder, name = posixpath.split(path)
    return f"{folder}/.{name}"


class RecordWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.gaps = options.get("gaps", "false") == "true"

    def write(self, rows) -> Written:
        system, root = _open(self.path)
        files, now, out, following = [], None, None, None
        try:
            for r in rows:
                if r.source_id != now or (r.i0 != following and not self.gaps):
                    if out:
                        out.close()
                    folder = f"source_id={r.source_id}"
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    files.append(f"{folder}/part-{r.i0}-{uuid.uuid4().hex}.dat")
                    out, now = system.open_output_stream(f"{root}/{_hidden(files[-1])}"), r.source_id
                out.write(bytes(r.content))
                following = r.i0 + r.records
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        made = {f"{root}/{f}" for m in messages if m for f in m.files}
        old = [p for p, _ in list_files(self.path)] if self.overwrite and system.get_file_info(root).type.name != "NotFound" else []
        for m in messages:
            for f in m.files if m else ():
                system.move(f"{root}/{_hidden(f)}", f"{root}/{f}")
        for p in old:
            if p not in made:
                system.delete_file(p)

    def abort(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{root}/{_hidden(f)}")


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return ", ".join(["path string", "i bigint", *_layout(self.options)[1]])

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStreamReader:
        return RecordStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


# ------------------------------------------------------------------ API

_REGISTERED: set[str] = set()


def register(spark: SparkSession) -> None:
    """Make the format known to the session and this package known to its workers."""
    from shapecode.session import ship_package
    ship_package(spark)
    if spark.sparkContext.applicationId not in _REGISTERED:
        spark.dataSource.register(FixedRecords)
        _REGISTERED.add(spark.sparkContext.applicationId)


def read_records(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    """``path, i`` and the layout's columns, one row a record, in splits of whole records."""
    register(spark)
    reader = spark.read.format("fixed_records").option("layout", layout)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def stream_frames(spark: SparkSession, path: str, layout: str, frame_len: int, **options) -> DataFrame:
    """The frames of growing recordings as a stream ``path, i, frame`` (``i`` is the frame's number)."""
    register(spark)
    reader = spark.readStream.format("fixed_records").option("layout", layout).option("frame_len", str(frame_len)).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def write_records(blocks: DataFrame, path: str, record_bytes: int, mode: str = "append", one_file: bool = False) -> None:
    """Write ``(source_id, i0, content)`` blocks of whole records; neighbouring blocks of a source share a file.

    ``one_file`` keeps a source in one task and so in one file (as a recorder
    that appends to it would).
    """
    from pyspark.sql import functions as F
    register(blocks.sparkSession)
    rows = blocks.select("source_id", "i0", "content", F.floor(F.length("content") / record_bytes).cast("bigint").alias("records"))
    _write_blocks(rows, path, mode, one_file)


def _write_blocks(rows: DataFrame, path: str, mode: str, one_file: bool, **options) -> None:
    dealt = rows.repartition("source_id") if one_file else rows.repartitionByRange("source_id", "i0")
    dealt.sortWithinPartitions("source_id", "i0").write.format("fixed_records").mode(mode).options(**options).save(path)


def write_lines(lines: DataFrame, path: str, block: int = 4096, one_file: bool = False) -> None:
    """Text lines ``(source_id, i, line)`` as ``source_id=<id>/part-...`` files, in order of ``i``.

    A recording's lines travel in blocks of ``block`` positions (bounded
    groups) and neighbouring blocks share a file, so there are about as many
    files as recordings, whatever the number of tasks.  ``one_file`` as in
    :func:`write_records`, for readers that take the order from the file.
    """
    from pyspark.sql import functions as F
    register(lines.sparkSession)
    b = F.floor(F.col("i") / F.lit(block)).cast("bigint")
    g = lines.groupBy("source_id", b.alias("i0")).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("line", F.lit("")).alias("line")))).alias("_l"))
    content = F.concat(F.array_join(F.transform("_l", lambda z: z["line"]), "\n"), F.lit("\n")).cast("binary")
    _write_blocks(g.select("source_id", "i0", content.alias("content"), F.lit(1).cast("bigint").alias("records")), path, "append", one_file, gaps="true")


def partial_tails(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    """(path, length, n_records, remainder) of the files that end in a partial record."""
    from shapecode.sources.binary import inventory
    return inventory(spark, path, "*", record_bytes).where("remainder > 0")
