"""Byte ranges of files, so that one large file is read by many tasks.

Spark lists the files; the ranges of one file are scanned at once by tasks that do not yet know what their range begins
inside of, the driver chains what they found (an entry a range, as in Spark's own list of splits), and a second scan
reads every range from its true state. A range reads on past its end until what it began there is whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldlens.session import io_tasks
from fieldlens.sources import files

#: Bytes of a range and of one read.
RANGE_BYTES, READ_BYTES = 32 << 20, 4 << 20
RANGE = "path string, start long, end long, length long"


@dataclass
class Span:
    """Bytes [start, end) of a file."""

    path: str
    start: int
    end: int
    length: int

    def chunks(self, ahead: bool = False) -> Iterator[tuple[int, bytes]]:
        """(position, bytes) of the range, and with ``ahead`` of what follows it up to the end of the file."""
        fs, path = files.open_fs(self.path)
        with fs.open_input_file(path) as f:
            at = self.start
            while at < (self.length if ahead else self.end):
                f.seek(at)
                data = f.read(min(READ_BYTES, self.end - at if at < self.end else self.length - at))
                if not data:
                    raise ValueError(f"{self.path} is shorter than when it was listed")
                yield at, data
                at += len(data)

    def before(self, size: int) -> bytes:
        """Up to ``size`` bytes in front of the range."""
        fs, path = files.open_fs(self.path)
        first = max(0, self.start - size)
        with fs.open_input_file(path) as f:
            f.seek(first)
            return f.read(self.start - first)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length and partition columns of the data files below a folder, of a file or of a pattern."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", "length", *[c for c in found.columns if c not in ("path", "modificationTime", "length", "content")])


def file_ranges(found: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges of listed files, dealt to as many tasks as they have range sizes of bytes."""
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = found.filter("length > 0").select("path", starts.alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"), "length")
    return ranges.repartition(max(io_tasks(found.sparkSession), -(-total // range_bytes)))


def spans_of(batch: pa.RecordBatch) -> list[Span]:
    return [Span(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "length")), strict=True)]


def planned(spark: SparkSession, rows: list[tuple], schema: str | StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges (path, start, end, length first) with what is known of them, dealt like ``file_ranges``."""
    total = sum(r[2] - r[1] for r in rows)
    return spark.createDataFrame(rows, schema).repartition(max(io_tasks(spark), -(-total // range_bytes)))
