"""Elements of large JSON documents, read in byte ranges.

A range is scanned without knowing whether it begins inside a string or how deep: quotes that no backslash escapes give
the string state from either beginning, brackets outside strings the change of depth, and the separators are counted
by depth. Chained over the ranges of a file this is an index: string state, depth and number of elements in front of
each range. The second scan then finds where elements begin; a range owns those that begin in it and reads on until its
last one is whole. Every range is scanned by whole arrays, so the form of the text (indented, on one line) is all one.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldlens.sources.ranges import RANGE_BYTES, Span, file_ranges, listed, planned, spans_of

_DELTA = np.zeros(256, dtype=np.int64)
_DELTA[[ord("["), ord("{")]] = 1
_DELTA[[ord("]"), ord("}")]] = -1
_NOTED = np.zeros(256, dtype=bool)
_NOTED[[ord(c) for c in '[]{},"\n']] = True
_KEY = re.compile(rb'\s*("(?:[^"\\]++|\\.)*+")\s*:', re.S)
_BLANK = b" \t\r\n\xef\xbb\xbf"
_ENDS = {ord("["): ord("]"), ord("{"): ord("}")}


@dataclass
class Noted:
    """Brackets, separators and line breaks of a text: place, byte, quotes passed, and whether the text ends behind a backslash
    that escapes what follows."""

    at: np.ndarray
    byte: np.ndarray
    quotes: np.ndarray
    total: int
    escaping: bool


def noted(data: bytes, escaping: bool = False) -> Noted:
    b = np.frombuffer(data, dtype=np.uint8)
    slash = b == 92
    # a character is escaped behind an odd run of backslashes; a run that began before the text may be odd already
    last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
    run = np.arange(len(b)) - last_other
    if escaping:
        run = run + (last_other < 0)
    odd_behind = np.concatenate([[escaping], (run[:-1] % 2 == 1) & slash[:-1]]) if len(b) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(_NOTED[b] & ~((b == 34) & odd_behind))
    byte = b[at]
    quote = byte == 34
    passed = np.cumsum(quote)
    return Noted(at[~quote], byte[~quote], passed[~quote], int(passed[-1]) if len(passed) else 0, bool(len(b) and slash[-1] and run[-1] % 2 == 1) if len(b) else escaping)


def _escaping(span: Span) -> bool:
    """Whether the byte before the range escapes the first one."""
    size = 64
    while True:
        head = span.before(size)
        run = len(head) - len(head.rstrip(b"\\"))
        if run < len(head) or len(head) < size:
            return run % 2 == 1
        size *= 16


#: Bytes that are looked at in one go: the arrays made of them take some fifty times as much.
PIECE_BYTES = 256 << 10


def _pieces(span: Span, ahead: bool = False) -> Iterator[tuple[int, bytes]]:
    for at, data in span.chunks(ahead):
        for cut in range(0, len(data), PIECE_BYTES):
            yield at + cut, data[cut : cut + PIECE_BYTES]


INDEX = "path string, start long, end long, length long, quotes long, first int, depths array<long>, counts array<array<struct<depth:long,byte:int,n:long>>>"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each beginning (outside and inside a string) the change of depth and the separators by depth."""
    for b in batches:
        rows = []
        for span in spans_of(b):
            escaping, quotes, depths, counts, first = _escaping(span), 0, [0, 0], [Counter(), Counter()], None
            for _, data in _pieces(span):
                seen = noted(data, escaping)
                if span.start == 0 and first is None and data.strip(_BLANK):
                    first = data.strip(_BLANK)[0]
                for inside in (0, 1):
                    out = (seen.quotes + quotes + inside) % 2 == 0
                    delta = _DELTA[seen.byte[out]]
                    depth = depths[inside] + np.cumsum(delta)
                    counted = delta >= 0
                    kind = np.where(delta[counted] == 1, ord("["), seen.byte[out][counted])
                    keys, n = np.unique(np.stack([depth[counted], kind]), axis=1, return_counts=True)
                    for d, c, k in zip(*keys.tolist(), n.tolist(), strict=True):
                        counts[inside][d, c] += k
                    depths[inside] = int(depth[-1]) if len(depth) else depths[inside]
                quotes, escaping = quotes + seen.total, seen.escaping
            rows.append({
                "path": span.path, "start": span.start, "end": span.end, "length": span.length, "quotes": quotes, "first": first, "depths": depths,
                "counts": [[{"depth": d, "byte": c, "n": k} for (d, c), k in own.items()] for own in counts],
            })
        part = pa.list_(pa.struct([("depth", pa.int64()), ("byte", pa.int32()), ("n", pa.int64())]))
        schema = pa.schema([
            *[(c, pa.int64()) if c != "path" else (c, pa.string()) for c in ("path", "start", "end", "length", "quotes")], ("first", pa.int32()),
            ("depths", pa.list_(pa.int64())), ("counts", pa.list_(part)),
        ])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


PLAN = "path string, start long, end long, length long, inside boolean, depth long, number long, first int"


def _begins(depth: int, byte: int, level: int) -> bool:
    """Whether an element of the level may begin behind a separator, or behind a bracket that leads to ``depth``."""
    return depth == level and byte == ord("\n") if level == 0 else depth == level and byte in (ord(","), ord("["))


def _chained(ranges: DataFrame, level: int) -> list[tuple]:
    """PLAN rows: string state, depth and beginnings of elements in front of every range, files in order of their paths."""
    out, now, inside, depth, number, first = [], None, 0, 0, 0, None
    for r in [*sorted(ranges.mapInArrow(_indexed, INDEX).collect(), key=lambda r: (r["path"], r["start"])), None]:
        if r is None or r["path"] != now:
            if inside or depth:
                raise ValueError(f"malformed JSON: {now} ends inside a value")
            if r is None:
                return out
            now, first = r["path"], r["first"]
            number += level == 0  # the first line follows no separator
            if level and first not in _ENDS:
                raise ValueError(f"malformed JSON: {now} is neither an array nor an object")
        out.append((now, r["start"], r["end"], r["length"], bool(inside), depth, number, first))
        counts = r["counts"][inside]
        if level == 0 and any(c["byte"] == ord("\n") and c["depth"] + depth for c in counts):
            raise ValueError(f"malformed JSON: a document of {now} goes over several lines")
        number += sum(c["n"] for c in counts if _begins(c["depth"] + depth, c["byte"], level))
        depth += r["depths"][inside]
        inside = (inside + r["quotes"]) % 2


def _elements(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for span, inside, depth, number, first in zip(spans_of(b), *(b.column(c).to_pylist() for c in ("inside", "depth", "number", "first")), strict=True):
                yield from _owned(span, level, inside, depth, number, first)

    return run


def _owned(span: Span, level: int, inside: bool, depth: int, number: int, first: int) -> Iterator[pa.RecordBatch]:
    """Elements whose beginning lies in the range, with their numbers."""
    # the parts of an element that is open, and whether a bracket stands in front of it
    parts: list[bytes] | None = [] if level == 0 and span.start == 0 else None
    opened, escaping, quotes = False, _escaping(span), int(inside)
    for at, data in _pieces(span, ahead=True):
        if at >= span.end and parts is None:
            return
        seen = noted(data, escaping)
        out = (seen.quotes + quotes) % 2 == 0
        place, byte = seen.at[out], seen.byte[out]
        delta = _DELTA[byte]
        after = depth + np.cumsum(delta)
        if len(after) and (after.min() < 0 or (level and ((after == 0) & (delta < 0) & (byte != _ENDS[first])).any())):
            raise ValueError(f"malformed JSON: brackets of {span.path} do not match")
        parting = (delta == 0) & (after == level) & (byte == (ord(",") if level else ord("\n")))
        edge = parting if level == 0 else parting | (delta == 1) & (after == level) | (delta == -1) & (after == level - 1)
        found, cut, over = [], 0, False
        for k in np.flatnonzero(edge).tolist():
            p = int(place[k])
            if parts is not None:
                parts.append(data[cut:p])
                text = b"".join(parts).strip(_BLANK)
                if text:
                    found.append((number - 1, text))
                elif level and not (opened and delta[k] == -1):
                    raise ValueError(f"malformed JSON: an element of {span.path} is missing")
                parts = None
            cut = p + 1
            if at + p >= span.end:
                over = True
                break
            if delta[k] >= 0:
                number += 1
                parts, opened = [], bool(delta[k] == 1)
        if parts is not None:
            parts.append(data[cut:])
        if found:
            yield _batch(span, found)
        if over:
            return
        quotes, escaping, depth = quotes + seen.total, seen.escaping, int(after[-1]) if len(after) else depth
    last = b"".join(parts or ()).strip(_BLANK)
    if last:
        yield _batch(span, [(number - 1, last)])


def _batch(span: Span, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    values = pa.array([x for _, x in found], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(span.path), len(found)), pa.array([n for n, _ in found], pa.int64()), values], names=["path", "position", "value"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, values = [], []
        for text in b.column("value").to_pylist():
            raw = text.encode()
            head = _KEY.match(raw)
            if head is None:
                raise ValueError(f"malformed JSON: a member without a name: {text[:80]}")
            keys.append(json.loads(head[1]))
            values.append(raw[head.end() :].strip())
        columns = [b.column("path"), b.column("position"), pa.array(keys, pa.string()), pa.array(values, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "position", "key", "value"])


def json_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, position, value: the documents of files that hold one a line, as text. A document over several lines fails the job."""
    return _scanned(spark, path, 0, range_bytes)


def json_elements(spark: SparkSession, path: str, level: int = 1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, position, value: the elements (of an object: members) of files that hold one document each, as text.

    With ``level`` 2 they are those of the arrays and objects inside the document. Positions rise along the document,
    from 0 by one, and go on from file to file in order of their paths; an empty array takes up one. A string or bracket that stays open,
    brackets that do not match outside of elements, and missing elements fail the job.
    """
    return _scanned(spark, path, level, range_bytes)


def json_members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, position, key, value: the members of files that hold one object each."""
    return json_elements(spark, path, 1, range_bytes).mapInArrow(_members, "path string, position long, key string, value string")


def _scanned(spark: SparkSession, path: str, level: int, range_bytes: int) -> DataFrame:
    rows = _chained(file_ranges(listed(spark, path).select("path", "length"), range_bytes), level)
    return planned(spark, rows, PLAN, range_bytes).mapInArrow(_elements(level), "path string, position long, value string")
