"""CSV files with line breaks in values, read in byte ranges.

A range owns the lines that begin in it. At the start of a line a reader is either outside a quoted value or inside
one; a line takes each of the two states to one of the two, and so does a range, by composition. Once the states of
all ranges are chained, a range knows whether its first line begins a record, skips the rest of the record before it,
and reads on past its end until its own last record is whole. Records are then parsed by Spark as single CSV rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldlens.sources.ranges import RANGE_BYTES, Span, file_ranges, listed, planned, spans_of

_QUOTED = rb'"(?:[^"]++|"")*+"[^,]*+'
_VALUE = rb"(?:" + _QUOTED + rb'|[^",][^,]*+|)'
#: Lines that end outside, begun outside and inside. A quote in the middle of a value that has none in front is a character.
_FROM_OUTSIDE = re.compile(_VALUE + rb"(?:," + _VALUE + rb")*+", re.S)
_FROM_INSIDE = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(?:,' + _VALUE + rb")*+", re.S)


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is open at the end of a line."""
    if b'"' not in line:
        return inside
    return (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is None


def lines_of(span: Span) -> Iterator[tuple[list[bytes], bool]]:
    """Whole lines in order, many at a time, with whether they begin in the range; those after it follow as long as
    they are asked for."""
    rest, skipping = b"", span.start > 0 and span.before(1) != b"\n"
    begins = span.start
    for at, data in span.chunks(ahead=True):
        if skipping:
            cut = data.find(b"\n")
            if cut < 0:
                if at + len(data) >= span.end:
                    return
                continue
            data, skipping = data[cut + 1 :], False
            begins = at + cut + 1
            if begins >= span.end:
                return
        data = rest + data
        *lines, rest = data.split(b"\n")
        if not lines:
            continue
        # lines that begin before the end of the range, then the others
        if begins + len(data) - len(rest) <= span.end:
            yield lines, True
            begins += len(data) - len(rest)
            continue
        own = 0
        while own < len(lines) and begins < span.end:
            begins += len(lines[own]) + 1
            own += 1
        if own:
            yield lines[:own], True
        if own < len(lines):
            yield lines[own:], False
            begins += sum(len(x) + 1 for x in lines[own:])
        if begins >= span.end and not rest:
            # the next line is another range's; it is only read for a record that is still open
            continue
    if rest:
        yield [rest], begins < span.end


STATES = "path string, start long, end long, length long, outside boolean, inside boolean, breaks string"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the lines of a range lead, from outside and from inside; the line break of the file, from its first range."""
    for b in batches:
        out = []
        for span in spans_of(b):
            ends, breaks = [False, True], None
            for lines, own in lines_of(span):
                if not own:
                    break
                if span.start == 0 and breaks is None:
                    breaks = "\r\n" if lines[0].endswith(b"\r") else "\n"
                    if b"\r" in lines[0][:-1]:
                        raise ValueError(f"{span.path} parts lines by carriage returns alone")
                for line in lines:
                    if b'"' in line:
                        ends = [ends_inside(line, e) for e in ends]
            out.append((span.path, span.start, span.end, span.length, *ends, breaks))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in STATES.split(", ")])


def _chained(ranges: DataFrame) -> list[tuple]:
    """(path, start, end, length, inside, breaks) of every range: whether its first line goes on a value."""
    out, now, inside, breaks = [], None, False, None
    for r in [*sorted(ranges.mapInArrow(_states, STATES).collect(), key=lambda r: (r["path"], r["start"])), None]:
        if r is None or r["path"] != now:
            if inside:
                raise ValueError(f"malformed CSV: a quoted value of {now} has no end")
            if r is None:
                return out
            now, breaks = r["path"], r["breaks"] or "\n"
        out.append((now, r["start"], r["end"], r["length"], inside, breaks))
        inside = r["inside" if inside else "outside"]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin in a range, header and empty lines left out, with the partition columns of their file."""
    for b in batches:
        folders = b.schema.names[6:]
        for i, (span, inside, breaks) in enumerate(zip(spans_of(b), b.column("inside").to_pylist(), b.column("breaks").to_pylist(), strict=True)):
            named = [b.column(c)[i] for c in folders]
            # lines inside a value and none pending: the record is another range's
            header, pending = span.start == 0, []
            for lines, own in lines_of(span):
                if not own and not pending:
                    break
                held = pa.array(lines, pa.binary())
                quoted = np.flatnonzero(pc.match_substring(held, '"').to_numpy(zero_copy_only=False))
                parts, at, over = [], 0, False
                for q in (*quoted.tolist(), len(lines)):
                    if not inside:
                        parts.append(held.slice(at, q - at))
                    elif pending:
                        pending += lines[at:q]
                    if q == len(lines):
                        break
                    at, was = q + 1, inside
                    inside = ends_inside(lines[q], was)
                    if not was and not inside:
                        parts.append(held.slice(q, 1))
                    elif not was:
                        pending = [lines[q]]
                    elif pending:
                        pending.append(lines[q])
                    if was and not inside:
                        if pending:
                            parts.append(pa.array([b"\n".join(pending)], pa.binary()))
                        pending = []
                        if not own:
                            over = True
                            break
                whole = pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())
                if breaks == "\r\n":
                    whole = pc.replace_substring(pc.replace_substring_regex(whole, r"\r\z", ""), "\r\n", "\n")
                if header and len(whole):
                    whole, header = whole.slice(1), False
                whole = whole.filter(pc.greater(pc.binary_length(whole), 0))
                if len(whole):
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(v, len(whole)) for v in named), whole], names=[*folders, "value"])
                if over:
                    break


def csv_scan(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of CSV files with a header, doubled quotes and line breaks in values; the ranges of one file are read by
    many tasks. A value that does not fit its column, a row of another width and a quoted value without an end fail
    the job; empty lines are left out, partition columns come from the folder names."""
    found = listed(spark, path)
    given = StructType.fromDDL(schema)
    folders = [f for f in given if f.name in set(found.columns) - {"path", "length"}]
    own = StructType([f for f in given if f not in folders])
    rows = _chained(file_ranges(found.select("path", "length"), range_bytes))
    if folders:
        # a range brings the columns of its folder along: in a join the planner would take the records for as small as the list of ranges
        named = {r[0]: r[1:] for r in found.select("path", *[F.col(f"`{f.name}`").cast(f.dataType) for f in folders]).collect()}
        rows = [(*r, *named[r[0]]) for r in rows]
    plan = StructType.fromDDL("path string, start long, end long, length long, inside boolean, breaks string")
    carried = [StructField(f"_folder{i}", f.dataType) for i, f in enumerate(folders)]
    records = planned(spark, rows, StructType([*plan, *carried]), range_bytes)
    records = records.mapInArrow(_records, StructType([*carried, StructField("value", StringType())]))
    parsed = F.from_csv("value", own.toDDL(), {"escape": '"', "mode": "FAILFAST", "header": "false", "lineSep": "\n"}).alias("_row")
    place = {f.name: F.col(c.name) for f, c in zip(folders, carried, strict=True)}
    return records.select(*place.values(), parsed).select(*[place.get(f.name, F.col("_row")[f.name]).alias(f.name) for f in given])
