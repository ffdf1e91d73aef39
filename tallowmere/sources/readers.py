"""Readers: schemas are given, never inferred, and what does not fit is counted or fails."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def positional_schema(width: int, prefix: str = "c") -> StructType:
    """``width`` text columns ``c0``, ``c1``, ..."""
    return StructType([StructField(f"{prefix}{i}", StringType()) for i in range(width)])


def csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, line_feeds: bool = False, **options: str) -> DataFrame:
    """Comma-separated rows with a header, quoted by ``"``; only ``columns`` are parsed where given.  Malformed rows fail.

    With ``line_feeds`` quoted values may hold them; such files cannot be split, so a task reads a whole one.
    """
    own = {"header": "true", "quote": '"', "escape": '"', "multiLine": str(line_feeds).lower(), "mode": "FAILFAST"}
    d = spark.read.options(**(own | options)).schema(schema).csv(path)
    return d.select(*columns) if columns else d


def shape(spark: SparkSession, path: str, line_feeds: bool = False) -> DataFrame:
    """One row: how many ``columns`` the header of comma-separated files names, and how many ``rows`` follow, in all files below ``path``."""
    d = spark.read.options(recursiveFileLookup="true", header="true", quote='"', escape='"', multiLine=str(line_feeds).lower()).csv(path)
    return d.agg(F.lit(len(d.columns)).alias("columns"), F.count("*").alias("rows"))


def piped(spark: SparkSession, path: str, width: int, columns: dict[int, str] | None = None) -> DataFrame:
    """Rows of ``width`` fields separated by ``|`` without header, as text; ``columns`` picks and names positions."""
    d = spark.read.schema(positional_schema(width)).options(sep="|", header="false", quote="").csv(path)
    return d.select(*[F.nullif(F.trim(f"c{i}"), F.lit("")).alias(n) for i, n in columns.items()]) if columns else d


def widths(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """``(fields, rows)``: how many rows have how many fields, from the raw lines."""
    lines = spark.read.text(path)
    return lines.groupBy((F.length("value") - F.length(F.replace("value", F.lit(separator))) + 1).alias("fields")).agg(F.count("*").alias("rows"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, audit: bool = False) -> DataFrame:
    """One object a line.  A bad line fails; with ``audit`` it becomes a row whose ``_corrupt_record`` has it."""
    if not audit:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*kind.fields, StructField("_corrupt_record", StringType())])).option("mode", "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON value a file, over as many lines as it likes."""
    return spark.read.schema(schema).options(multiLine="true", mode="FAILFAST").json(path)


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select(*columns) if columns else d


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(path, modified, bytes)`` of all files below ``path`` that end in ``suffix``, on any file system that Spark reaches."""
    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=f"*{suffix}").load(path)
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


#: Files up to so many bytes are read by Spark as one value; larger ones are read in pieces of ``PIECE`` bytes by a task each.
WHOLE, PIECE = 64 << 20, 8 << 20


def _opened(path: str):
    """A file as Python workers reach it, by its URI; it can be sought."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _files(spark: SparkSession, path: str, pattern: str, whole: int) -> DataFrame:
    """``(path, length, content)`` of files; content only of those up to ``whole`` bytes."""
    d = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path)
    small = d.where(F.col("length") <= whole).select("path", "length", "content")
    large = d.where(F.col("length") > whole).select("path", "length", F.lit(None).cast("binary").alias("content"))
    # a task for each file: a large one takes as long as all of a partition of small ones
    return small.unionByName(large.repartition("path"))


def digests(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """``(path, bytes, sha256)`` of files of any size: no more than ``whole`` bytes, or a piece, of one are in memory."""

    def run(batches):
        for b in batches:
            out = []
            for where, content in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                h = hashlib.sha256(content or b"")
                if content is None:
                    with _opened(where) as f:
                        while piece := f.read(PIECE):
                            h.update(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["path", "bytes", "sha256"])

    return _files(spark, path, "*", whole).mapInArrow(run, "path string, bytes long, sha256 string")


def _entries(f, where: str = ""):
    """``(name, info, opened entry)`` of an archive's entries and of those of archives within; an entry is read as it is unpacked."""
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name = f"{where}!{info.filename}" if where else info.filename
            with z.open(info) as e:
                if info.filename.lower().endswith(".zip"):
                    yield from _entries(e, name)
                else:
                    yield name, info, e


def _archive(where: str, content: bytes | None):
    return _opened(where) if content is None else io.BytesIO(content)


def nested_zip_lines(spark: SparkSession, path: str, member: str, whole: int = WHOLE) -> DataFrame:
    """``(archive, entry, line_number, line)`` of the text entries whose name contains ``member``, in archives or archives within these.

    An archive cannot be split, so a task reads a whole one, as a stream: neither it nor an entry is held in
    memory, and its lines are given out in batches; write the result as Parquet once and work on that.
    """

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows: list = []
                with _archive(where, content) as f:
                    for name, info, e in _entries(f):
                        if member not in info.filename:
                            continue
                        for number, line in enumerate(e):
                            rows.append((where, name, number, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                            if len(rows) == 20_000:
                                yield _batch(rows, ["archive", "entry", "line_number", "line"])
                                rows = []
                if rows:
                    yield _batch(rows, ["archive", "entry", "line_number", "line"])

    return _files(spark, path, "*.zip", whole).mapInArrow(run, "archive string, entry string, line_number long, line string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def zip_members(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """``(archive, entry, bytes, compressed, lines, sha256)`` of every entry, those of archives within too, read in pieces.

    A damaged archive or entry fails.  Compare ``entry`` with the names that must be there by ``checks.holes``.
    """

    def run(batches):
        for b in batches:
            for where, content in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows = []
                with _archive(where, content) as f:
                    for name, info, e in _entries(f):
                        h, size, lines, last = hashlib.sha256(), 0, 0, b""
                        while piece := e.read(PIECE):
                            h.update(piece)
                            size, lines, last = size + len(piece), lines + piece.count(b"\n"), piece[-1:]
                        rows.append((where, name, size, info.compress_size, lines + (last not in (b"", b"\n")), h.hexdigest()))
                if rows:
                    yield _batch(rows, ["archive", "entry", "bytes", "compressed", "lines", "sha256"])

    return _files(spark, path, "*.zip", whole).mapInArrow(run, "archive string, entry string, bytes long, compressed long, lines long, sha256 string")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of an SQL store, read in ranges of a numeric key at once."""
    o = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**(o | options)).load()


def yaml_document(path: str) -> object:
    """A YAML file of settings, on the driver; needs the yaml package."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
