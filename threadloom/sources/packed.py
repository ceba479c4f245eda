"""Packed page files, some of which may be damaged: all pages before the damage, and an account of it.

Many pages, one JSON object per line, are packed into one file, compressed or not. The reader of
:mod:`threadloom.sources.pages` leaves a damaged file without a word; this one unpacks every file until
its first error, gives the lines that came before it, and one row more that says what is wrong. A file
is read by one task, piece by piece, and must fit its memory while compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import schemas
from threadloom.sources.pages import with_filename

#: Compressed bytes unpacked at once, and bytes of lines given on at once.
CHUNK, HELD = 1 << 18, 4 << 20

_ROWS = "file string, line long, value string, problem string, bytes_read long"
_GZIP = b"\x1f\x8b"


class _Damaged(Exception):
    """What is wrong with a file, and where its sound bytes end."""

    def __init__(self, problem: str, at: int):
        super().__init__(problem)
        self.at = at


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The text of a file, of any number of compressed members, piece by piece."""
    if content[:2] != _GZIP:
        yield from (content[at : at + CHUNK] for at in range(0, len(content), CHUNK))
        return
    at = 0
    while at < len(content):
        if content[at : at + 2] != _GZIP:
            if content[at:].strip(b"\0"):
                raise _Damaged("no compressed data behind a member", at)
            return  # padding
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = content[at : at + CHUNK]
            if not piece:
                raise _Damaged("cut off", at)
            before = member.copy()
            try:
                text = member.decompress(piece)
            except zlib.error:
                for i in range(len(piece)):
                    try:
                        yield before.decompress(piece[i : i + 1])
                    except zlib.error:
                        raise _Damaged("damaged", at + i) from None
            at += len(piece) - len(member.unused_data)
            yield text


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield from _lines_of(path.as_py(), content.as_py())


def _lines_of(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    names = ["file", "line", "value", "problem", "bytes_read"]
    rest, number, problem, at = b"", 0, None, len(content)
    held: list[bytes] = []

    def given() -> pa.RecordBatch:
        n = len(held)
        values = pa.array([line.decode("utf-8", "replace") for line in held], pa.string())
        lines = pa.array(range(number - n, number), pa.int64())
        empty = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), lines, values, *empty], names)

    size = 0
    try:
        for text in _unpacked(content):
            *whole, rest = (rest + text).split(b"\n")
            held += whole
            number += len(whole)
            size += len(text)
            if size > HELD:
                yield given()
                held.clear()
                size = 0
    except _Damaged as found:
        problem, at = str(found), found.at
    if rest and problem is None:
        held.append(rest)
        number += 1
    yield given()
    if problem is not None:
        columns = [[path], [None], [None], [problem], [at]]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value, problem, bytes_read``: the lines of packed files, and a row per damaged file.

    A line that the damage cuts is not given. Rows of a problem have no line; ``bytes_read`` is the
    number of sound bytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_lines, _ROWS)


def packed_pages(lines: DataFrame) -> DataFrame:
    """The pages of :func:`read_packed`, as those of :func:`threadloom.sources.pages.read_pages`."""
    page = F.from_json("value", schemas.PAGE).alias("page")
    pages = lines.where("line is not null and trim(value) <> ''").select(F.col("file"), page)
    return with_filename(pages.select("page.*", "file"), "file")


def unreadable_pages(lines: DataFrame) -> DataFrame:
    """``file, pages_read, bad_lines, problem, bytes_read`` of the files with damage or lines that are no page.

    ``problem`` and ``bytes_read`` are null for a file that was read to its end.
    """
    filled = F.col("line").isNotNull() & (F.trim("value") != "")
    sound = F.coalesce(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.lit(False))
    counted = lines.groupBy("file").agg(
        F.count_if(filled & sound).alias("pages_read"),
        F.count_if(filled & ~sound).alias("bad_lines"),
        F.max("problem").alias("problem"),
        F.max("bytes_read").alias("bytes_read"),
    )
    return counted.where("problem is not null or bad_lines > 0")
