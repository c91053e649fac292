"""CSV files whose quoted fields may hold line breaks, read in byte ranges.

Where a record ends depends on whether a line starts inside quotes, which depends on all lines before it.
Lines of a range map that state to another, and such maps compose, so a file is read in parallel twice:

1. Each range of a file is summed up for both states that it may start in: the state that it ends in and the
   records that start in it. The driver composes these few numbers per range in file order, which gives each range
   its true state and the number of its first record. The same pass makes a digest of the file's lines that
   doesn't depend on how the file is split.
2. Each range parses the records that lie within it. A record that crosses borders leaves a fragment in each
   range, and the fragments of a record meet by its number; nothing else is shuffled.

Format: a header, commas, fields in double quotes with quotes doubled, lines ended by \\n, \\r\\n or \\r, UTF-8.
A quote counts as such at the start of a field only. Names and values are trimmed, empty lines are skipped, values
beyond the header are dropped, and of columns with one name, whatever its case, the last counts. A record that is too short, text
behind a closing quote, a header without a name and a quote that is never closed fail the whole file.
Several files (a folder) each have the header of the first; their records are numbered by file name.
"""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.sources.catalog import written

_BLANKS = "".join(map(chr, range(33)))
# the digest of lines h1, h2, ... is ((h1 * BASE + h2) * BASE + ...) mod PRIME, which composes by ranges
_PRIME, _BASE = (1 << 255) - 19, int.from_bytes(hashlib.sha256(b"lines of a file").digest(), "big")
_MIN_PARTS = "spark.sql.files.minPartitionNum"


class CsvError(ValueError):
    pass


def walk(line: str, inside: bool) -> tuple[bool, bool]:
    """(whether the line ends inside quotes, whether it is well formed) for a line that starts inside or not."""
    at, good = 0, True
    while True:
        if not inside:
            if line.startswith('"', at):
                at += 1
            else:
                comma = line.find(",", at)
                if comma < 0:
                    return False, good
                at = comma + 1
                continue
        close = line.find('"', at)
        while close >= 0 and line.startswith('"', close + 1):
            close = line.find('"', close + 2)
        if close < 0:
            return True, good
        inside = False
        comma = line.find(",", close)
        good = good and not line[close + 1 : comma if comma >= 0 else len(line)].strip(_BLANKS)
        if comma < 0:
            return False, good
        at = comma + 1


def physical(text: str) -> list[tuple[str, str]]:
    """(line, its end) of what \\n ends: more than one where \\r alone ends lines too."""
    if "\r" not in text:
        return [(text, "\n")]
    whole = text.endswith("\r")
    pieces = (text[:-1] if whole else text).split("\r")
    return [*((p, "\r") for p in pieces[:-1]), (pieces[-1], "\r\n" if whole else "\n")]


@dataclass
class Range:
    """What a byte range does to each state (outside, inside): the state after it and the records begun."""

    end: list[bool]
    begun: list[int]
    digest: int = 0
    lines: int = 0
    header: str = ""

    def line(self, text: str) -> None:
        quotes = '"' in text
        for s in (0, 1):
            if not self.end[s] and text:
                self.begun[s] += 1
            if quotes and (self.end[s] or text):
                self.end[s] = walk(text, self.end[s])[0]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, start), lines) in order; a range may come in several pieces."""
    for frame in frames:
        files, starts = frame.column(0).dictionary_encode(), frame.column(1).to_numpy()
        new = (np.diff(files.indices.to_numpy()) != 0) | (np.diff(starts) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), frame.num_rows]
        for at, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop > at:
                yield (files[at].as_py(), int(starts[at])), frame.column(2).slice(at, stop - at).to_pylist()


def _summed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: what it does to both states, its digest, and the lines of a file's first record."""
    key, r = None, None
    names = ["file", "start", "end_outside", "end_inside", "begun_outside", "begun_inside", "digest", "lines", "header"]

    def row() -> pa.RecordBatch:
        values = [*key, r.end[0], r.end[1], r.begun[0], r.begun[1], r.digest.to_bytes(32, "big"), r.lines, r.header]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

    for k, lines in _blocks(frames):
        if k != key:
            if r:
                yield row()
            key, r = k, Range([False, True], [0, 0])
        digest = r.digest
        for raw in lines:
            digest = (digest * _BASE + int.from_bytes(hashlib.blake2b(raw, digest_size=16).digest(), "big")) % _PRIME
            for text, end in physical(raw.decode("utf-8", "replace")):
                if key[1] == 0 and r.begun[0] < 2 and (r.begun[0] == 0 or r.end[0]):
                    r.header += text + end  # up to the end of the first record
                r.line(text.removeprefix("﻿") if key[1] == 0 and r.lines == 0 else text)
        r.digest, r.lines = digest, r.lines + len(lines)
    if r:
        yield row()


_SUMMED = "file string, start long, end_outside boolean, end_inside boolean, begun_outside long, begun_inside long, digest binary, lines long, header string"


def _parsed(lines: list[str]) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return [[v.strip(_BLANKS) for v in r] for r in csv.reader(lines) if r]


@dataclass
class Scan:
    """A file whose ranges are summed up."""

    lines: DataFrame
    columns: list[str]
    places: list[int]
    begins: dict[tuple[str, int], tuple[bool, int, int, int]]  # range -> starts inside, number of the record before, records of earlier files, ordinal
    digest: str
    total: int
    min_parts: str
    error: str | None = None

    def records(self) -> DataFrame:
        """All records: the columns as texts and _row, the record's number. Written, so that whatever fails fails here."""
        if self.error:
            raise CsvError(self.error)
        spark = self.lines.sparkSession
        if not self.columns:
            return spark.createDataFrame([], "_row long")
        with _same_ranges(spark, self.min_parts):
            found = written(self.lines.mapInArrow(_parser(self.begins, self.places), "_row long, fields array<string>, piece int, text string"), "csv-records")
        crossing = found.filter("fields IS NULL AND _row > 0").groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "").alias("text"))
        crossing = crossing.mapInArrow(_joined(self.places), "_row long, fields array<string>")
        rows = found.filter("fields IS NOT NULL").select("_row", "fields").unionByName(crossing)
        return rows.select(*[F.col("fields")[i].alias(c) for i, c in enumerate(self.columns)], "_row")


def _chosen(rows: list[list[str]], places: list[int]) -> list[list[str]]:
    least = max(places) + 1
    for r in rows:
        if len(r) < least:
            raise CsvError(f"a record has {len(r)} values of {least}")
    return [[r[i] for i in places] for r in rows]


def _joined(places: list[int]):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            fields = [_chosen(_parsed(_kept(t.as_py())), places)[0] for t in frame.column(1)]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(fields, pa.list_(pa.string()))], names=["_row", "fields"])

    return run


def _kept(text: str) -> list[str]:
    """Lines of one record with their ends."""
    out = [line + end for some in text.split("\n") for line, end in physical(some)]
    return out[:-1] if text.endswith("\n") else out


def _parser(begins: dict, places: list[int]):
    """Parse the records within a range; what crosses its borders is handed on as text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        inside = first = False
        number = offset = ordinal = 0  # the header of a file is its record 0
        held: list[str] = []  # lines of the record that is open
        foreign = False  # it began in an earlier range

        def row(n: int) -> int:
            return offset + n if n else 0

        def batch(rows: list, fields: list, pieces: list, texts: list) -> pa.RecordBatch:
            cols = [pa.array(rows, pa.int64()), pa.array(fields, pa.list_(pa.string())), pa.array(pieces, pa.int32()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["_row", "fields", "piece", "text"])

        for k, lines in _blocks(frames):
            fragments: list[tuple[int, int, str]] = []
            if k != key:
                if key and held:
                    fragments.append((row(number), ordinal, "".join(held)))
                if k not in begins:
                    raise CsvError("the file or its ranges changed while it was read")
                key, held, first = k, [], True
                inside, number, offset, ordinal = begins[k]
                foreign = inside
            done: list[str] = []
            before = number + (not (foreign or held))  # number of the first record that is completed here
            ended = 0
            for raw in lines:
                for text, end in physical(raw.decode("utf-8", "replace")):
                    if first and k[1] == 0:
                        text = text.removeprefix("﻿")
                    first = False
                    if not inside and not text:
                        continue
                    if not inside:
                        number += 1
                    held.append(text + end)
                    if '"' in text:
                        inside, good = walk(text, inside)
                        if not good:
                            raise CsvError(f"text behind a closing quote in record {number}")
                    if inside:
                        continue
                    if foreign:
                        fragments.append((row(number), ordinal, "".join(held)))
                        foreign, before = False, number + 1
                    else:
                        done += held
                        ended += 1
                    held = []
            rows = _parsed(done)
            if len(rows) != ended:
                raise CsvError("records can't be told apart")
            numbers = list(range(before, before + ended))
            if numbers and numbers[0] == 0:
                numbers, rows = numbers[1:], rows[1:]
            numbers = [row(n) for n in numbers]
            n, m = len(rows), len(fragments)
            if n or m:
                yield batch(numbers + [f[0] for f in fragments], _chosen(rows, places) + [None] * m, [None] * n + [f[1] for f in fragments], [None] * n + [f[2] for f in fragments])
        if key and held:
            yield batch([row(number)], [None], [ordinal], ["".join(held)])

    return run


class _same_ranges:
    """Files are cut into the same ranges inside, whatever executors come and go."""

    def __init__(self, spark: SparkSession, parts: str):
        self.spark, self.parts = spark, parts

    def __enter__(self):
        self.before = self.spark.conf.get(_MIN_PARTS, None)
        self.spark.conf.set(_MIN_PARTS, self.parts)

    def __exit__(self, *_):
        if self.before is None:
            self.spark.conf.unset(_MIN_PARTS)
        else:
            self.spark.conf.set(_MIN_PARTS, self.before)


def scan(spark: SparkSession, path: str) -> Scan:
    """Sum up the ranges of a CSV file (or the files of a folder). What is wrong with it is said when the records are
    asked for."""
    error = None
    parts = spark.conf.get(_MIN_PARTS, None) or str(spark.sparkContext.defaultParallelism)
    lines = _lines(spark, path)
    with _same_ranges(spark, parts):
        ranges = sorted(lines.mapInArrow(_summed, _SUMMED).collect(), key=lambda r: (r["file"], r["start"]))  # a row a range
    digest, begins, records, file = 0, {}, 0, None
    state, in_file, header = False, 0, ""
    for n, r in enumerate(ranges):
        if r["file"] != file:
            if state:
                error = "a quote isn't closed"
            records += max(0, in_file - 1)
            file, state, in_file = r["file"], False, 0
            if header and r["header"].removeprefix("﻿").strip() != header.strip():
                error = "files have different headers"
            header = header or r["header"].removeprefix("﻿")
            if in_file == 0 and r["begun_outside"] == 1 and r["end_outside"] and n + 1 < len(ranges) and ranges[n + 1]["file"] == file:
                error = "the header is longer than a range of the file"
        begins[r["file"], r["start"]] = (state, in_file - 1, records, n)
        digest = (digest * pow(_BASE, r["lines"], _PRIME) + int.from_bytes(r["digest"], "big")) % _PRIME
        in_file += r["begun_inside" if state else "begun_outside"]
        state = r["end_inside" if state else "end_outside"]
    if state:
        error = "a quote isn't closed"
    names = (_parsed(_kept(header)) or [[]])[0]
    if any(not n for n in names):
        error = "a header name is missing"
    last = {n.lower(): (n, i) for i, n in enumerate(names)}
    return Scan(lines, [n for n, _ in last.values()], [i for _, i in last.values()], begins, hashlib.sha256(digest.to_bytes(32, "big")).hexdigest(), records + max(0, in_file - 1), parts, error)
