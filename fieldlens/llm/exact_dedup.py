"""Exact duplicates by content sort: equal texts become neighbours, neighbours are compared in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.base import prepare, keep_rows, row_key
from fieldlens.session import materialized

#: Characters of the text in the range splitters: they are sampled on the driver, so they must be short.
SPLITTER_CHARS = 64
#: A run of white space other than one single blank; a single blank already is what it would become.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), RUN, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of equal neighbours of a sorted partition; only the last text is carried over."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column("norm")
        same = np.zeros(b.num_rows, dtype=bool)
        same[0] = last is not None and norm[0].as_py() == last
        if b.num_rows > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        number = run + np.cumsum(~same)
        run, last = int(number[-1]), norm[b.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), b.column("sha"), pa.array(np.full(b.num_rows, part, dtype=np.int64)),
             pa.array(number.astype(np.int64)), pa.array(~same)],
            names=["doc_id", "th", "sha", "part", "run", "head"],
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The rows are range partitioned on (leading characters, digest, doc_id), so the copies of one text lie side by
    side and a text with any number of copies still spreads over many partitions. Within a partition every text is
    compared in full with the one before it; runs that a splitter has cut are put together again by digest, on a
    table with one row per run.

    Null text is empty text. Rows repeated with the same doc_id count as copies and one of them stays. A null
    doc_id comes after all others; a group of only such rows keeps one and has a null keep_id. An empty table
    gives an empty result. Other columns are ignored.
    """
    return _placed(docs).drop("th")


def _placed(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), F.xxhash64("text").alias("th"))
    base = base.withColumn("sha", F.sha2("norm", 256))
    order = [F.substring("norm", 1, SPLITTER_CHARS), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    laid = base.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialized(
        laid.mapInArrow(_runs, "doc_id long, th long, sha string, part long, run long, head boolean"), "exact-runs"
    )
    runs = rows.groupBy("part", "run").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n"), F.min("sha").alias("_sha"))
    groups = runs.groupBy("_sha").agg(
        F.min("_first").alias("keep_id"), F.sum("_n").alias("group_size"), F.min("part").alias("_part")
    )
    placed = runs.select("part", "run", "_sha").join(groups, "_sha").drop("_sha")
    return rows.join(placed, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", (F.col("head") & (F.col("part") == F.col("_part"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "th",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of every group of equals, with all their columns."""
    kept = _placed(docs).filter("kept").select(row_key()[0], F.col("th").alias("_th"))
    return keep_rows(docs, kept)
