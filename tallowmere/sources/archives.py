"""Lines of archived text entries, a task for each entry.

A ZIP archive has a directory of its entries at its end, and an entry that is stored as it is lies at a known place: an
archive that is stored in another can be read as if it were a file.  So the partitions are all entries that can be reached
without unpacking anything.  An archive that its outer one has deflated cannot be entered at a place; it is one partition, which reads its
entries as a stream.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import PIECE, _entries, _opened

LINES = 20_000
SCHEMA = "archive string, entry string, line_number long, line string"


class Slice(io.RawIOBase):
    """Bytes ``start`` to ``start + length`` of a file that can be sought, as a file of its own."""

    def __init__(self, f, start: int, length: int):
        self.f, self.start, self.length, self.at = f, start, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.at, self.length)[whence]
        if at < 0:
            raise OSError("a place before the ZIP archive's beginning")
        self.at = at
        return at

    def readinto(self, into) -> int:
        n = max(0, min(len(into), self.length - self.at))
        if n:
            self.f.seek(self.start + self.at)
            got = self.f.read(n)
            n = len(got)
            into[:n] = got
            self.at += n
        return n


def _buffered(f, start: int, length: int) -> io.BufferedReader:
    return io.BufferedReader(Slice(f, start, length), 1 << 20)


def _data_at(f, info: zipfile.ZipInfo) -> int:
    """Where an entry's bytes begin: behind its own header, whose lengths may differ from those in the directory."""
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no header of {info.filename} where the directory has it")
    return info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


class Entry(InputPartition):
    """An entry of the (inner) archive that lies at ``start``; ``whole``: an inner archive that is read as a stream."""

    def __init__(self, archive: str, start: int, length: int, name: str, shown: str, whole: bool, size: int):
        super().__init__(shown)
        self.archive, self.start, self.length, self.name, self.shown, self.whole, self.size = archive, start, length, name, shown, whole, size


def entries(path: str, member: str = "") -> list[Entry]:
    """The entries whose name matches ``member``, in an archive and those stored in it, and the deflated archives that may have some.

    Only directories are read.  An entry that is named twice fails.
    """

    def inside(f, start: int, length: int, shown: str) -> Iterator[Entry]:
        with _buffered(f, start, length) as b, zipfile.ZipFile(b) as z:
            b.seek(max(0, length - 22 - len(z.comment)))
            if b.read(4) != b"PK\x05\x06":
                raise zipfile.BadZipFile(f"{path}: {shown or 'it'} does not end with its ZIP directory")
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len({i.filename for i in infos}) < len(infos):
                raise zipfile.BadZipFile(f"{path}: an entry's name is there twice in {shown or 'it'}")
            for info in infos:
                name = f"{shown}!{info.filename}" if shown else info.filename
                inner = info.filename.lower().endswith(".zip")
                if inner and info.compress_type == zipfile.ZIP_STORED and not info.flag_bits & 1:
                    yield from inside(f, start + _data_at(b, info), info.file_size, name)
                elif inner or re.search(member, info.filename):
                    yield Entry(path, start, length, info.filename, name, inner, info.file_size)

    with _opened(path) as f:
        return list(inside(f, 0, f.size(), ""))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.member = json.loads(options["paths"]), options.get("member", "")
        self.digests, self.names = json.loads(options.get("sha256", "{}")), json.loads(options.get("entries", "null"))

    def partitions(self) -> list[Entry]:
        found = [e for p in self.paths for e in entries(p, self.member)]
        if self.names is not None:
            own, right = sorted(n for e in found for n in self._names(e)), sorted(self.names)
            if own != right:
                raise ValueError(f"entries that are missing: {sorted(set(right) - set(own))}, that must not be there: {sorted(set(own) - set(right))}")
        return found

    def _names(self, e: Entry) -> list[str]:
        """The entries of a partition; a deflated archive is unpacked once, as a stream, to see its directory."""
        if not e.whole:
            return [e.shown]
        with _opened(e.archive) as f, _buffered(f, e.start, e.length) as b, zipfile.ZipFile(b) as z, z.open(e.name) as inner:
            return [name for name, info, _ in _entries(inner, e.shown) if re.search(self.member, info.filename)]

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        with _opened(partition.archive) as f, _buffered(f, partition.start, partition.length) as b, zipfile.ZipFile(b) as z, z.open(partition.name) as e:
            if partition.whole:
                for name, info, inner in _entries(e, partition.shown):
                    if re.search(self.member, info.filename):
                        yield from self._lines(partition.archive, name, inner, info.file_size)
            else:
                yield from self._lines(partition.archive, partition.shown, e, partition.size)

    def _lines(self, archive: str, name: str, e, size: int) -> Iterator[pa.RecordBatch]:
        """An entry's lines in batches; its CRC is checked as it ends, its size and SHA-256 after that."""
        if self.names is not None and name not in self.names:
            raise ValueError(f"{name} must not be there")
        h, seen, number, rest = hashlib.sha256(), 0, 0, b""

        def batch(lines: list[bytes], first: int) -> pa.RecordBatch:
            n = len(lines)
            texts = [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.record_batch([pa.array([archive] * n), pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(texts)], names=["archive", "entry", "line_number", "line"])

        while piece := e.read(PIECE):
            h.update(piece)
            seen += len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            for i in range(0, len(lines), LINES):
                yield batch(lines[i : i + LINES], number)
                number += len(lines[i : i + LINES])
        if rest:
            yield batch([rest], number)
        if seen != size:
            raise zipfile.BadZipFile(f"{name} has {seen} bytes, its directory says {size}")
        if self.digests and self.digests.get(name) != h.hexdigest():
            raise ValueError(f"{name} has SHA-256 {h.hexdigest()}, not {self.digests.get(name)}")


class ArchiveLines(DataSource):
    """Format ``archive_lines``; options ``paths`` (a JSON list), ``member``, ``sha256`` (JSON: entry to digest), ``entries`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def archive_lines(spark: SparkSession, paths: list[str], member: str = "", sha256: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """``(archive, entry, line_number, line)`` of the text entries whose name matches the expression ``member``.

    ``paths`` are URIs; inner entries are named ``outer.zip!entry``.  Each entry is a task, and no more than a piece of it is in memory.
    It fails, never skips: a damaged directory, an encrypted entry, a CRC or size that differs; with ``sha256`` an entry whose
    digest differs or isn't given; with ``names`` (all entries that match) one that is missing or must not be there.
    """
    spark.dataSource.register(ArchiveLines)
    own = {"paths": json.dumps(paths), "member": member}
    if sha256 is not None:
        own["sha256"] = json.dumps(sha256)
    if names is not None:
        own["entries"] = json.dumps(names)
    return spark.read.format("archive_lines").options(**own).load()
