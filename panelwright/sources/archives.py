"""A1, A3, A4. Delimited members of ZIP archives, read in place by Spark tasks.

Archives are listed by Spark's file source (paths only, no content). Tasks
open them through the file system of their path and seek: the index read
touches the end of the file, a member read touches only that member. Nothing
is extracted to disk and no archive travels through a shuffle. One member is
one deflate stream, so it is the unit of work; it is streamed in batches.
"""

from __future__ import annotations

import codecs
import csv
import datetime
import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import ship_package, tasks_for

# UTF-8 with or without its mark, and what is read as single bytes otherwise.
UNICODE, SINGLE_BYTE = "utf-8-sig", "latin-1"
CHUNK_BYTES = 1 << 20
# Blocks of the reader of delimited text, which holds up to 32 of them; the larger one for records that the smaller can't hold.
BLOCK_BYTES = (CHUNK_BYTES // 2, 8 * CHUNK_BYTES)

INDEX_SCHEMA = "archive string, path string, member string, version_ts string, crc32 string, bytes bigint, error string"
# What a task says of a member that it couldn't read to its end.
ROW, ERROR = "row", "error"


def list_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """``path`` of each archive, its name below the folder (``archive``), its size and time.

    The content column is pruned, so files are listed only. The name doesn't change when the folder moves.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    below = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root), F.lit(r"\E/")), 2), -1)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", below.alias("archive"), F.col("length").alias("archive_bytes"), F.col("modificationTime").alias("modified"))
    )


def file_system(path: str):
    """File system and inner path of a local path or a URI, for use inside tasks."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    filesystem, inner = file_system(path)
    return filesystem.open_input_file(inner)


def _index(handle) -> zipfile.ZipFile:
    """The archive's index; a file without room for the end record can't be searched for one."""
    if handle.size() < zipfile.sizeEndCentDir:
        raise zipfile.BadZipFile("File is not a zip file")
    return zipfile.ZipFile(handle)


def member_encoding(stream: BinaryIO) -> str:
    """A3. Reads a member to its end: UTF-8 if every byte of it is, else single bytes."""
    reader = codecs.getincrementaldecoder("utf-8")("strict")
    try:
        for chunk in iter(lambda: stream.read(CHUNK_BYTES), b""):
            reader.decode(chunk)
        reader.decode(b"", final=True)
    except UnicodeDecodeError:
        return SINGLE_BYTE
    return UNICODE


def member_header(stream: BinaryIO, encoding: str, sep: str) -> list[str]:
    """The first record, by the rules of CSV: separators and line ends inside quotes belong to a name."""
    with io.TextIOWrapper(stream, encoding, newline="") as lines:
        return next(csv.reader(lines, delimiter=sep), [""])


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


def archive_index(archives: DataFrame) -> DataFrame:
    """A1. One row per ``.csv`` member with version and CRC, from the archives' indexes alone.

    A file that is no archive gives one row with ``error``, an empty member and the file's own time as version;
    the others go on. Archives are dealt out one by one over all tasks.
    """
    ship_package(archives.sparkSession)
    arrow = pa.schema([("bytes", pa.int64()) if n == "bytes" else (n, pa.string()) for n in T.StructType.fromDDL(INDEX_SCHEMA).names])

    def members_of(archive: str, path: str, modified: str) -> Iterator[dict]:
        found = {"archive": archive, "path": path}
        try:
            with _open(path) as handle, _index(handle) as index:
                for info in index.infolist():
                    if info.filename.lower().endswith(".csv"):
                        when = datetime.datetime(*info.date_time).isoformat()
                        yield found | {"member": info.filename, "version_ts": when, "crc32": f"{info.CRC:08x}", "bytes": info.file_size}
        except (zipfile.BadZipFile, NotImplementedError, ValueError) as error:  # storage that fails ends the task, which runs again
            yield found | {"member": "", "version_ts": modified, "error": _reason(error)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = list(members_of(**row))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    modified = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("modified")
    listed = archives.select("archive", "path", modified).repartition(tasks_for(archives.sparkSession))
    return listed.mapInArrow(read, INDEX_SCHEMA)


def probe_members(members: DataFrame, sep: str = ";") -> DataFrame:
    """A3–A4. Encoding and header of each member; ``error`` for one that can't be read. Reads members to their end."""
    ship_package(members.sparkSession)
    schema = T.StructType(members.schema.fields)
    schema = schema.add("encoding", "string").add("header", T.ArrayType(T.StringType()))
    error_at = members.columns.index("error")

    def probe(row: dict) -> tuple[str | None, list[str] | None, str | None]:
        try:
            with _open(row["path"]) as handle, _index(handle) as index:
                with index.open(row["member"]) as stream:
                    encoding = member_encoding(stream)
                with index.open(row["member"]) as stream:
                    return encoding, member_header(stream, encoding, sep), None
        except UNREADABLE as error:
            return None, None, _reason(error)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "member", "error"]).to_pylist()
            found = [(None, None, r["error"]) if r["error"] is not None else probe(r) for r in rows]
            batch = batch.set_column(error_at, "error", pa.array([f[2] for f in found], pa.string()))
            batch = batch.append_column("encoding", pa.array([f[0] for f in found], pa.string()))
            yield batch.append_column("header", pa.array([f[1] for f in found], pa.list_(pa.string())))

    return members.repartition(tasks_for(members.sparkSession)).mapInArrow(read, schema)


def archive_members(archives: DataFrame, sep: str = ";") -> DataFrame:
    """A1, A3. Every member with version, CRC, encoding and header."""
    return probe_members(archive_index(archives), sep)


def file_contract(members: DataFrame, required: Sequence[str]) -> DataFrame:
    """A4. ``missing`` columns per member; a member lacking any is refused whole."""
    wanted = F.array(*[F.lit(c) for c in required])
    missing = F.array_sort(F.array_except(wanted, F.coalesce("header", F.array().cast("array<string>"))))
    status = (
        F.when(F.col("error").isNotNull() & (F.col("member") == ""), F.lit("bad_archive"))
        .when(F.col("error").isNotNull(), F.lit("unreadable"))
        .when(F.size(missing) > 0, F.lit("rejected"))
        .otherwise(F.lit("accepted"))
    )
    return members.withColumn("missing", missing).withColumn("contract", status)


def header_columns(members: DataFrame) -> list[str]:
    """Column names of the accepted members, sorted: the schema of the scan."""
    names = members.select(F.explode("header").alias("c")).distinct()
    return sorted(r["c"] for r in names.collect())  # schema, not data


CARRIED = ("archive", "member", "version_ts", "crc32")


class RowTooLong(Exception):
    """A record has more fields than the header."""


# Faults of a member, as opposed to those of the storage.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, csv.Error, pa.ArrowInvalid, RowTooLong)


def tagged_rows(
    members: DataFrame, columns: Sequence[str], sep: str = ";", carried: Sequence[str] = CARRIED
) -> DataFrame:
    """A1–A2, B6. Rows of the given members, every field as text, and what went wrong, in one pass.

    ``tag`` is ``row`` for a record. A member that can't be read to its end (a bad checksum, a broken stream, a record with
    more fields than the header) has one row with the tag ``error`` and a ``reason``, besides the records before the fault.
    Members are spread so that each is one task's work, then streamed batch by batch. A record with fewer fields
    is filled up with empty ones. Columns a member lacks are NULL; its other columns all survive. The ``carried``
    columns of a member are repeated on its rows.
    """
    ship_package(members.sparkSession)
    carried, columns = list(carried), list(columns)
    names = ["tag", "reason", *carried, *columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    arrow = pa.schema([(c, pa.string()) for c in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with _open(row["path"]) as handle, _index(handle) as index:
                        yield from member_batches(index, row)
                except UNREADABLE as error:
                    yield pa.RecordBatch.from_pylist([{"tag": ERROR, "reason": _reason(error), **{c: row[c] for c in carried}}], schema=arrow)

    def member_batches(index: zipfile.ZipFile, row: dict) -> Iterator[pa.RecordBatch]:
        given = {"whole": 0, "short": 0}
        for size in BLOCK_BYTES:
            try:
                with index.open(row["member"]) as raw:
                    yield from text_batches(raw, row, size, given)
                return
            except pa.ArrowInvalid as error:
                if size == BLOCK_BYTES[-1] or "block" not in str(error):
                    raise

    def text_batches(raw, row: dict, block_bytes: int, given: dict[str, int]) -> Iterator[pa.RecordBatch]:
        """Whole and short records, each after as many as are ``given`` already, which counts on."""
        buffered = io.BufferedReader(raw, CHUNK_BYTES)
        if row["encoding"] == UNICODE and buffered.peek(3)[:3] == codecs.BOM_UTF8:
            buffered.read(3)
        skipped = dict(given)
        short: list[str] = []

        def odd(record) -> str:
            if record.actual_columns > record.expected_columns:
                return "error"
            short.append(record.text)
            return "skip"

        header = row["header"]
        reader = pacsv.open_csv(
            buffered,
            read_options=pacsv.ReadOptions(encoding=SINGLE_BYTE if row["encoding"] == SINGLE_BYTE else "utf8", block_size=block_bytes),
            parse_options=pacsv.ParseOptions(delimiter=sep, newlines_in_values=True, invalid_row_handler=odd),
            convert_options=pacsv.ConvertOptions(column_types={c: pa.string() for c in header}, strings_can_be_null=False),
        )

        def shaped(size: int, fields: dict[str, pa.Array]) -> pa.RecordBatch:
            fixed = {"tag": ROW, "reason": None, **{c: row[c] for c in carried}}
            own = [pa.repeat(pa.scalar(v, pa.string()), size) for v in fixed.values()]
            return pa.RecordBatch.from_arrays([*own, *(fields[c] if c in fields else pa.nulls(size, pa.string()) for c in columns)], schema=arrow)

        def left(kind: str, records):
            past = min(skipped[kind], len(records))
            skipped[kind] -= past
            given[kind] += len(records) - past
            return records[past:]

        def filled() -> Iterator[pa.RecordBatch]:
            found = short[:]
            del short[: len(found)]  # the reader works ahead and may have added to it
            if texts := left("short", found):
                fields = [next(csv.reader([text], delimiter=sep), []) for text in texts]
                whole = [r + [""] * (len(header) - len(r)) for r in fields]
                yield shaped(len(whole), {c: pa.array(v, pa.string()) for c, v in zip(header, zip(*whole, strict=True), strict=True)})

        for block in reader:
            new = left("whole", block)
            yield shaped(new.num_rows, dict(zip(new.schema.names, new.columns, strict=True)))
            yield from filled()
        yield from filled()

    chosen = members.select(*dict.fromkeys([*carried, "path", "member", "encoding", "header"]))
    return chosen.repartition(tasks_for(members.sparkSession)).mapInArrow(read, schema)


def member_rows(
    members: DataFrame, columns: Sequence[str], sep: str = ";", carried: Sequence[str] = CARRIED
) -> DataFrame:
    """A1–A2. The records of :func:`tagged_rows`; a member that can't be read ends the query with its reason."""
    rows = tagged_rows(members, columns, sep, carried)
    fault = F.concat(F.lit("member "), F.col("member") if "member" in carried else F.lit(""), F.lit(" can't be read: "), "reason")
    kept = F.when(F.col("tag") == ERROR, F.raise_error(fault)).otherwise(F.lit(True))
    return rows.where(kept.cast("boolean")).drop("tag", "reason")
