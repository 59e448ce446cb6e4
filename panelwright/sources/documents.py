"""A5. JSON documents with a ``value`` list, read item by item.

A document is one text and can't be split, but it needn't be held either: a task reads it in chunks and passes
its items on in Arrow batches, so a document of any size takes the memory of one chunk, one batch and its
longest item. Many documents are read side by side.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelwright.session import ship_package, tasks_for
from panelwright.sources.archives import file_system

CHUNK_BYTES = 1 << 20
BATCH_ITEMS = 10_000
SPACE = " \t\r\n"
ENDS = frozenset(SPACE + ",:]}")


class DocumentRefused(Exception):
    """A5. The document has no ``value`` list, or isn't JSON."""


class _Reader:
    """Text of a stream, of which only what hasn't been understood yet is kept."""

    def __init__(self, stream: BinaryIO, chunk: int):
        self.stream, self.chunk, self.rest, self.over = stream, chunk, "", False
        self.decode = codecs.getincrementaldecoder("utf-8-sig")("strict").decode
        # Numbers stay as they are written.
        self.parse = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str).raw_decode

    def more(self) -> bool:
        if self.over:
            return False
        raw = self.stream.read(max(self.chunk, len(self.rest)))  # a long item is tried again a few times only
        self.over = not raw
        self.rest += self.decode(raw, final=self.over)
        return True

    def peek(self) -> str:
        """The next character that isn't space, or nothing at the end."""
        while True:
            self.rest = self.rest.lstrip(SPACE)
            if self.rest or not self.more():
                return self.rest[:1]

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise DocumentRefused(f"{wanted!r} expected, not {self.rest[:20]!r}")
        self.rest = self.rest[1:]

    def item(self) -> object:
        """The next value. One that nothing follows yet may go on, as a number after its point does."""
        self.peek()
        while True:
            try:
                found, end = self.parse(self.rest)
                if self.rest[end : end + 1] in ENDS or not self.more():
                    self.rest = self.rest[end:]
                    return found
            except ValueError as error:
                if not self.more():
                    raise DocumentRefused(str(error)) from None


def document_items(stream: BinaryIO, chunk: int = CHUNK_BYTES) -> Iterator[object]:
    """The items of the list under the first key ``value`` of the outermost object."""
    reader = _Reader(stream, chunk)
    reader.take("{")
    if reader.peek() == "}":
        raise DocumentRefused("no list of values")
    while True:
        name = reader.item()
        reader.take(":")
        if name == "value" and reader.peek() == "[":
            break
        reader.item()
        if reader.peek() != ",":
            raise DocumentRefused("no list of values")
        reader.take(",")
    reader.take("[")
    if reader.peek() != "]":
        yield reader.item()
        while reader.peek() == ",":
            reader.take(",")
            yield reader.item()
    reader.take("]")


def as_text(value: object) -> str | None:
    """A field as text: text and numbers as written, the rest as JSON, null as NULL."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.repartition(tasks_for(spark))


def document_columns(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names of the fields that occur, sorted: the schema of the scan. A document without values is refused."""
    ship_package(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                names: dict[str, None] = {}
                refused = None
                try:
                    filesystem, inner = file_system(file)
                    with filesystem.open_input_stream(inner) as stream:
                        for item in document_items(stream):
                            if isinstance(item, dict):
                                names.update(dict.fromkeys(item))
                except (DocumentRefused, UnicodeDecodeError) as error:
                    refused = f"{file}: {error}"
                yield pa.RecordBatch.from_pydict({"name": pa.array([*names, None], pa.string()), "refused": pa.array([None] * len(names) + [refused], pa.string())})

    rows = _paths(spark, path).mapInArrow(read, "name string, refused string").distinct().collect()  # schema, not data
    if bad := sorted(r["refused"] for r in rows if r["refused"]):
        raise DocumentRefused("; ".join(bad[:5]))
    return sorted(r["name"] for r in rows if r["name"] is not None)


def read_documents(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """A5. One row per item, every field as text; fields that an item lacks are NULL.

    With ``columns``, documents are read once; else a first pass finds their names. Items that are no objects are no rows.
    """
    names = list(columns) if columns is not None else document_columns(spark, path)
    ship_package(spark)
    arrow = pa.schema([(n, pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                filesystem, inner = file_system(file)
                with filesystem.open_input_stream(inner) as stream:
                    held: list[list[str | None]] = []
                    for item in document_items(stream):
                        if isinstance(item, dict):
                            held.append([as_text(item.get(n)) for n in names])
                        if len(held) >= BATCH_ITEMS:
                            yield batch_of(held)
                            held = []
                    if held:
                        yield batch_of(held)

    def batch_of(rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=arrow)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not names:
        return spark.createDataFrame([], schema)
    return _paths(spark, path).mapInArrow(read, schema)
