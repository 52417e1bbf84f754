"""CSV files with line breaks in cells, split into byte ranges that tasks read alone.

A line end is real where the quotes before it are even in number; a doubled quote in a
cell counts twice and changes nothing. So a first pass counts the quotes and lines of
each byte range, sums over the ranges of a file tell how each range begins, and a
second pass cuts the ranges into records, each by itself. Only records that lie in
several ranges meet once more. The charset of a file comes from the same first pass.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgrisk.session import scratch_path

# The charsets of files, in the order they are tried.
CHARSETS = ("utf-8", "gbk", "latin-1")

CELLS = {
    "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}

_RANGE = (
    "file string, block bigint, lines bigint, odd boolean, ends bigint, utf8 boolean, "
    "gbk boolean, head binary, head_number bigint"
)
_RECORD = "file_id int, position bigint, block bigint, record string, open boolean"


@dataclass(frozen=True)
class File:
    """One file: its charset, the cells of its header, and the header's record number."""

    path: str
    charset: str
    names: list[str]
    header: int


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Physical lines as bytes with the file and the byte range they begin in.

    Line ends are those of the byte 10 only, which no character of the charsets has in it.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _stretches(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, pa.Array, int, int]]:
    """The parts of a batch that lie in one byte range: its key, lines, and place."""
    columns = [batch.column(batch.schema.get_field_index(k)).dictionary_encode() for k in keys]
    codes = [c.indices.to_numpy() for c in columns]
    changed = np.zeros(batch.num_rows, bool)
    changed[:1] = True
    for c in codes:
        changed[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(changed)
    lines = batch.column(batch.schema.get_field_index("line"))
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
        key = tuple(c.dictionary[int(i[a])].as_py() for c, i in zip(columns, codes))
        yield key, lines.slice(a, b - a), int(a), int(b)


def _joined(lines: pa.Array) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), b"\n")[0].as_py()


def _fits(data: bytes, charset: str) -> bool:
    try:
        data.decode(charset)
    except UnicodeDecodeError:
        return False
    return True


class _Facts:
    """What is to be known of a byte range, from its lines in order."""

    def __init__(self, key: tuple):
        self.key, self.lines, self.quotes, self.ends = key, 0, 0, 0
        self.fits = {c: True for c in CHARSETS[:2]}
        self.head: bytes | None = None
        self.held: list[bytes] = []
        self.head_number = 0

    def add(self, lines: pa.Array) -> None:
        odd = (self.quotes + np.cumsum(pc.count_substring(lines, '"').to_numpy())) % 2 == 1
        if self.key[1] == 0 and self.head is None:
            self._find_head(lines, odd)
        self.ends += int((~odd).sum())
        self.quotes = int(odd[-1])
        self.lines += len(lines)
        data = _joined(lines)
        if not data.isascii():
            for charset, fits in self.fits.items():
                self.fits[charset] = fits and _fits(data, charset)

    def _find_head(self, lines: pa.Array, odd: np.ndarray) -> None:
        """The first record of the file that is not blank."""
        for line, goes_on in zip(lines, odd):
            self.held.append(line.as_py())
            if goes_on:
                continue
            record = b"\n".join(self.held)
            if record.strip(b"\r\n \t\xef\xbb\xbf"):
                self.head = record
                return
            self.held, self.head_number = [], self.head_number + 1

    def row(self) -> dict:
        head = self.head
        if head is None and self.held:  # a quote that never closes
            head = b"\n".join(self.held)
        values = (*self.key, self.lines, self.quotes == 1, self.ends, *self.fits.values(), head, self.head_number)
        names = [part.split()[0] for part in _RANGE.split(", ")]
        return {n: [v] for n, v in zip(names, values)}


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("lines", pa.int64()), ("odd", pa.bool_()),
        ("ends", pa.int64()), ("utf8", pa.bool_()), ("gbk", pa.bool_()), ("head", pa.binary()),
        ("head_number", pa.int64()),
    ])
    now: _Facts | None = None
    for batch in batches:
        for key, lines, _, _ in _stretches(batch, "file", "block"):
            if now is None or now.key != key:
                if now is not None:
                    yield pa.RecordBatch.from_pydict(now.row(), schema)
                now = _Facts(key)
            now.add(lines)
    if now is not None:
        yield pa.RecordBatch.from_pydict(now.row(), schema)


def _safe_names(names: list[str]) -> list[str]:
    """Names of columns as Spark gives them: numbered where empty or repeated."""
    lower = [n.lower() for n in names]
    return [
        f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)
    ]


def _described(facts: DataFrame) -> list[File]:
    """One entry per file with a header, from the rows of its byte ranges."""
    per_file = facts.groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"), F.bool_and("gbk").alias("gbk"),
        F.max("head").alias("head"), F.max_by("head_number", F.col("head").isNotNull()).alias("n"),
    )
    csv.field_size_limit(1 << 30)
    found = []
    for row in per_file.collect():
        if row["head"] is None:
            continue
        charset = CHARSETS[0] if row["utf8"] else CHARSETS[1] if row["gbk"] else CHARSETS[2]
        text = bytes(row["head"]).decode(charset).removeprefix("﻿").rstrip("\r")
        names = next(csv.reader([text]), [])
        found.append(File(row["file"], charset, _safe_names(names), row["n"]))
    return sorted(found, key=lambda f: f.path)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of byte ranges; ``open`` marks those that begin or end outside."""
    schema = pa.schema([
        ("file_id", pa.int32()), ("position", pa.int64()), ("block", pa.int64()),
        ("record", pa.string()), ("open", pa.bool_()),
    ])
    key, held, odd, number, head_open = None, [], False, 0, False

    def made(records: list[str], first: int, open_: list[bool]) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * n, pa.int32()), pa.array(np.arange(first, first + n)),
            pa.array([key[1]] * n, pa.int64()), pa.array(records, pa.string()), pa.array(open_, pa.bool_()),
        ], schema=schema)

    def rest() -> Iterator[pa.RecordBatch]:
        if key is not None and held:
            yield made([_joined(pa.concat_arrays(held)).decode(CHARSETS[key[2]])], number, [True])

    for batch in batches:
        for found, lines, at, _ in _stretches(batch, "file_id", "block", "charset"):
            if found != key:
                yield from rest()
                key, held = found, []
                odd = batch.column(batch.schema.get_field_index("starts_odd"))[at].as_py()
                number = batch.column(batch.schema.get_field_index("first"))[at].as_py()
                head_open = odd
            quotes = pc.count_substring(lines, '"').to_numpy()
            parity = (int(odd) + np.cumsum(quotes)) % 2 == 1
            odd = bool(parity[-1])
            ends = np.flatnonzero(~parity)
            if not len(ends):
                held.append(lines)
                continue
            before = sum(map(len, held))
            whole = pa.concat_arrays([*held, lines.slice(0, int(ends[-1]) + 1)])
            offsets = np.append(0, ends + 1 + before).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), whole), b"\n")
            if key[2] == 0:
                records = joined.cast(pa.string()).to_pylist()
            else:
                records = [r.decode(CHARSETS[key[2]]) for r in joined.to_pylist()]
            yield made(records, number, [head_open, *[False] * (len(records) - 1)])
            number += len(records)
            head_open = False
            held = [lines.slice(int(ends[-1]) + 1)] if ends[-1] + 1 < len(lines) else []
    yield from rest()


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[File]]:
    """``(file_id, position, record)`` and the files, which the ids number.

    Headers and blank records are left out; ``position`` is the number of a record in its
    file, the first one below the header being 0, blank ones counted. A quote that never
    closes leaves the rest of its file as one record, as other readers have it. A record is
    one value and must fit a task. One job runs here, the first pass. The driver gets a row
    per file; the facts of byte ranges (one row each) are broadcast, so the
    rows of files are never shuffled, whatever the sizes of files.
    """
    staged = scratch_path(spark, "csv-ranges")
    _lines(spark, paths).mapInArrow(_facts, _RANGE).write.parquet(staged)
    facts = spark.read.schema(_RANGE).parquet(staged)
    files = _described(facts)
    ids = spark.createDataFrame(
        [(f.path, i, CHARSETS.index(f.charset), f.header) for i, f in enumerate(files)],
        "file string, file_id int, charset int, header bigint",
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts_odd = F.coalesce(F.count_if("odd").over(before), F.lit(0)) % 2 == 1
    ranges = facts.select("file", "block", "odd", "lines", "ends").withColumn("starts_odd", starts_odd)
    closed = F.when(F.col("starts_odd"), F.col("lines") - F.col("ends")).otherwise(F.col("ends"))
    ranges = ranges.withColumn("closed", closed)
    first = F.coalesce(F.sum("closed").over(before), F.lit(0))
    ranges = ranges.withColumn("first", first).join(F.broadcast(ids), "file")
    ranges = ranges.select("file", "block", "file_id", "charset", "starts_odd", "first")
    any_open = not ranges.filter("starts_odd").isEmpty()
    marked = _lines(spark, paths).join(F.broadcast(ranges), ["file", "block"])
    marked = marked.select("line", "file_id", "block", "charset", "starts_odd", "first")
    pieces = marked.mapInArrow(_cut, _RECORD)
    records = pieces.filter("NOT open").select("file_id", "position", "record")
    # A last record whose quote never closes is open too, and no range need start odd then.
    last_odd = facts.groupBy("file").agg((F.count_if("odd") % 2 == 1).alias("odd")).filter("odd")
    if any_open or not last_odd.isEmpty():
        parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
        opened = pieces.filter("open").groupBy("file_id", "position").agg(
            F.array_join(parts, "\n").alias("record")
        )
        records = records.unionByName(opened)
    placed = records.join(F.broadcast(ids.select("file_id", "header")), "file_id")
    placed = placed.filter(F.col("position") > F.col("header"))
    text = F.regexp_replace("record", "\r+\\z", "")
    placed = placed.select(
        "file_id", (F.col("position") - F.col("header") - 1).alias("position"), text.alias("record")
    )
    return placed.filter(F.col("record").rlike("[^ \t\r\n]")), files


def read_table(
    spark: SparkSession, paths: list[str], carried: dict[str, Column] | None = None
) -> DataFrame:
    """All records of the files with a column per name of their headers, as text.

    Columns go by name; one that a file lacks is null there. ``position`` comes on top, and
    the columns ``carried``, expressions over ``file``, the path. The plan has one scan
    and one place per column, however many files and headers there are.
    """
    records, files = read_records(spark, paths)
    if not files:
        raise ValueError("the files are empty")
    names = list(dict.fromkeys(n for f in files for n in f.names))
    width = max(len(f.names) for f in files)
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), CELLS)
    listed = F.array(*[F.col("_cells")[f"c{i}"] for i in range(width)])
    places = [(i, f.path, [f.names.index(n) if n in f.names else -1 for n in names]) for i, f in enumerate(files)]
    known = spark.createDataFrame(places, "file_id int, file string, _places array<int>")
    extra = {n: c.alias(n) for n, c in (carried or {}).items()}
    known = known.select("file_id", "_places", *extra.values())
    rows = records.withColumn("_cells", cells).select("file_id", "position", listed.alias("_cells"))
    rows = rows.join(F.broadcast(known), "file_id")
    columns = [
        F.when(F.col("_places")[i] >= 0, F.get("_cells", F.col("_places")[i])).alias(n)
        for i, n in enumerate(names)
    ]
    taken = {n.lower() for n in names}
    more = [n for n in ("position", *extra) if n.lower() not in taken]
    return rows.select(*columns, *more)
