"""Sources by name: ``spark.read.format("chronoloom_snapshot")`` and ``format("chronoloom_queue")``, the latter also of a stream.

Files are cut into byte ranges, each read by a task; a line belongs to the range in which it begins, and only ``\\n`` ends it, so the separators that
JSON allows inside strings are no line ends. Paths may be of any store that pyarrow knows."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship
from .views import PROPOSAL

RANGE = 64 << 20  # bytes a task
PIECE = 1 << 20  # bytes a read
LINES = T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.StringType()), T.StructField("position", T.LongType())])


class Bytes(InputPartition):
    """Lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Whole(InputPartition):
    """A snapshot's checksum, over all of its file."""

    def __init__(self, path: str):
        self.path = path


class Line(NamedTuple):
    at: int
    text: bytes


def _open(path: str):
    """(filesystem, path in it)."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path


def files_of(path: str) -> dict[str, int]:
    """{path: bytes} of a file, or of the files right inside a folder whose names begin with neither "." nor "_"."""
    from pyarrow import fs

    store, inside = _open(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return {path: info.size}
    found = [f for f in store.get_file_info(fs.FileSelector(inside)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return {f"{path.rstrip('/')}/{f.base_name}": f.size for f in sorted(found, key=lambda f: f.base_name)}


def lines_of(path: str, start: int, end: int) -> Iterator[Line]:
    """Lines that begin in [start, end), with where they do; read in pieces, one line held at a time."""
    store, inside = _open(path)
    with store.open_input_file(inside) as f:
        at, held = start, bytearray()
        if start:  # what began before is another range's: go on behind the end of the line that the byte before is in
            at = start - 1
            f.seek(at)
            skipping = True
        else:
            skipping = False
        while piece := f.read(PIECE):
            begin = 0
            while (stop := piece.find(b"\n", begin)) >= 0:
                held += piece[begin:stop]
                if not skipping:
                    yield Line(at, bytes(held))
                at += len(held) + 1
                held.clear()
                skipping, begin = False, stop + 1
                if at >= end:
                    return
            if skipping:
                at += len(piece) - begin
            else:
                held += piece[begin:]
        if held and not skipping:
            yield Line(at, bytes(held))


def ranges(path: str, start: int, end: int, most: int) -> list[Bytes]:
    return [Bytes(path, a, min(a + most, end)) for a in range(start, end, most)]


def parsed(path: str, line: Line) -> dict | None:
    """A line's object; None if it is blank; an error that tells where it is if it is none."""
    text = line.text.strip(b" \t\r")
    if not text:
        return None
    try:
        found = json.loads(text.removeprefix(codecs.BOM_UTF8) if not line.at else text)
    except ValueError as e:
        raise ValueError(f"{path}: byte {line.at}: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path}: byte {line.at}: not an object")
    return found


# ---------------------------------------------------------------- snapshots


def first_line(path: str) -> tuple[dict, int]:
    """A snapshot's header, and where its records begin."""
    from ..operators.review import FORMATS

    for line in lines_of(path, 0, 1 << 62):
        if (head := parsed(path, line)) is None:
            continue
        if head.get("kind") != "export":
            raise ValueError(f"{path}: no export header")
        if head.get("format_version") not in FORMATS:
            raise ValueError(f"{path}: format {head.get('format_version')} is not supported")
        return head, line.at + len(line.text) + 1
    raise ValueError(f"{path}: empty file")


class _SnapshotReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        head, begin = first_line(self.path)
        size = files_of(self.path)[self.path]
        return [Whole(self.path)] * (head["format_version"] == 2) + ranges(self.path, begin, max(size, begin + 1), self.most)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from ..operators.review import KINDS

        if isinstance(partition, Whole):
            self._check()
            return
        for line in lines_of(partition.path, partition.start, partition.end):
            found = parsed(partition.path, line)
            if found is None:
                continue
            if found.get("kind") not in KINDS:
                raise ValueError(f"{partition.path}: byte {line.at}: unknown kind {found.get('kind')!r}")
            yield found["kind"], line.text.rstrip(b"\r").decode(), line.at

    def _check(self) -> None:
        """The checksum goes on from line to line, so one task reads the file for it, a piece at a time; the others read their ranges meanwhile."""
        head, begin = first_line(self.path)
        digest, n = hashlib.sha256(), 0
        for line in lines_of(self.path, begin, 1 << 62):
            if line.text.strip():
                digest.update(line.text.rstrip(b"\r") + b"\n")
                n += 1
        if (head.get("record_count"), head.get("sha256")) != (n, digest.hexdigest()):
            raise ValueError(f"{self.path}: count or checksum does not match")


class SnapshotSource(DataSource):
    """(kind, line, position) of the records of a snapshot in one file. Its header is read where the scan is planned. The first task holds
    count and checksum against it and gives no row, so a job over a snapshot that was changed fails, whichever rows it wants.

    Options: ``path``; ``range_bytes``, the bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "chronoloom_snapshot"

    def schema(self) -> T.StructType:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SnapshotReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))


# ---------------------------------------------------------------- queues


def proposal(row: dict, schema: T.StructType) -> tuple:
    """A row of the schema from an object; what it lacks is null, and what is no text where text must be is kept as JSON."""
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def of(field: T.StructField):
        v = row.get(field.name)
        if not isinstance(field.dataType, T.ArrayType):
            return text(v)
        if v is not None and not isinstance(v, list):
            raise ValueError(f"{field.name} is no list")
        if isinstance(field.dataType.elementType, T.StringType):
            return None if v is None else [text(x) for x in v]
        if any(x is not None and (isinstance(x, bool) or not isinstance(x, int)) for x in v or ()):
            raise ValueError(f"{field.name} is no list of whole numbers")
        return v

    return tuple(of(f) for f in schema.fields)


def _proposals(partition: Bytes, schema: T.StructType) -> Iterator[tuple]:
    for line in lines_of(partition.path, partition.start, partition.end):
        if (found := parsed(partition.path, line)) is None:
            continue
        try:
            row = proposal(found, schema)
        except ValueError as e:
            raise ValueError(f"{partition.path}: byte {line.at}: {e}") from e
        yield row


class _QueueReader(DataSourceReader):
    def __init__(self, path: str, most: int, schema: T.StructType):
        self.path, self.most, self.schema = path, most, schema

    def partitions(self) -> list[InputPartition]:
        return [r for path, size in files_of(self.path).items() for r in ranges(path, 0, size, self.most)] or [Bytes(self.path, 0, 0)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        return _proposals(partition, self.schema) if partition.end else iter(())


def ended(path: str, start: int, size: int) -> int:
    """Where the last line that has its end ends: what is behind it is still being written. Read from the file's end, a piece at a time."""
    store, inside = _open(path)
    with store.open_input_file(inside) as f:
        stop = size
        while stop > start:
            begin = max(start, stop - PIECE)
            f.seek(begin)
            found = f.read(stop - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            stop = begin
    return start


class _QueueStream(DataSourceStreamReader):
    """Offsets are {file: bytes up to the end of its last whole line}. Files may grow and be added; one that shrinks, or goes, was replaced,
    which is an error: a queue is only appended to."""

    def __init__(self, path: str, most: int, schema: T.StructType):
        self.path, self.most, self.schema = path, most, schema
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        sizes = files_of(self.path)
        self._grown(self.seen, sizes)
        self.seen = {p: ended(p, self.seen.get(p, 0), size) for p, size in sizes.items()}
        return dict(self.seen)

    @staticmethod
    def _grown(before: dict[str, int], after: dict[str, int]) -> None:
        if lost := sorted(p for p, n in before.items() if after.get(p, -1) < n):
            raise ValueError(f"{lost[0]}: shorter than what was read of it")

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._grown(start, end)
        return [r for path, stop in sorted(end.items()) for r in ranges(path, start.get(path, 0), stop, self.most)]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        return _proposals(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class QueueSource(DataSource):
    """Proposals of a queue: a file of JSON lines, or a folder of such. A line that is no object, or does not fit the schema, fails the read and is
    named by its file and byte. Of a stream, a micro-batch has the lines that were ended since the one before.

    Options: ``path``; ``range_bytes``, the bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "chronoloom_queue"

    def schema(self) -> T.StructType:
        return PROPOSAL

    def _how(self, schema: T.StructType) -> tuple:
        return self.options["path"], int(self.options.get("range_bytes", RANGE)), schema

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _QueueReader(*self._how(schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _QueueStream(*self._how(schema))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and their code to its executors."""
    ship(spark)
    for source in (SnapshotSource, QueueSource):
        spark.dataSource.register(source)
