"""Order statistics and ranks of names without sorting the table.

Names are compared as bytes, so a histogram of the bytes that follow a common prefix is a histogram in name order. The
one bin that holds a wanted rank is cut into bins again until its rows fit a short list; each pass is a narrow
aggregate with map-side combine. Where every row needs its rank, bins that are still large are cut further until none
holds more than a small share of the rows, and rows are ranked inside their bin.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.ordering import ranked

#: Rows of a bin that are listed instead of being cut again, and bins of which none is large.
LISTED, BINS = 10_000, 256
#: Bytes that a histogram adds to the prefix: at most 65,536 bins and the end of a name.
STEP = 2


def as_bytes(value: Column) -> Column:
    """A name as bytes that compare like it; null comes first."""
    return F.when(value.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), F.encode(value.cast("string"), "UTF-8")))


def _bins(rows: DataFrame, prefix: int) -> list:
    cut = F.substring("_v", 1, prefix + STEP).alias("bin")
    found = rows.groupBy(cut).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    return sorted(found.collect(), key=lambda r: bytes(r["bin"]))


def pivot(df: DataFrame, value: Column, share: float) -> tuple[bytes | None, int, int, int]:
    """The ``floor(share * n)``-th smallest name, as bytes; how many names are smaller, how many equal it, and how many
    of the equal ones are up to that rank. Without rows up to the rank the name is None."""
    rows = df.select(as_bytes(value).alias("_v"))
    ends = rows.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    rank = int(share * ends["n"])
    if rank < 1:
        return None, 0, 0, 0
    before, n, low, high = 0, ends["n"], bytes(ends["low"]), bytes(ends["high"])
    while low != high:
        prefix = os.path.commonprefix([low, high])
        rows = rows.filter(F.substring("_v", 1, len(prefix)) == F.lit(prefix))
        if n <= LISTED:
            for r in sorted(rows.groupBy("_v").count().collect(), key=lambda r: bytes(r["_v"])):
                if before + r["count"] >= rank:
                    return bytes(r["_v"]), before, r["count"], rank - before
                before += r["count"]
        for r in _bins(rows, len(prefix)):
            if before + r["n"] >= rank:
                n, low, high = r["n"], bytes(r["low"]), bytes(r["high"])
                # a name that ends with the prefix is a bin of its own, others share all its bytes
                rows = rows.filter(F.substring("_v", 1, len(prefix) + STEP) == F.lit(bytes(r["bin"])))
                break
            before += r["n"]
    return low, before, n, rank - before


def up_to(df: DataFrame, value: Column, share: float, out: str) -> DataFrame:
    """``out``: whether a row is among the first ``floor(share * n)`` in the order of names. Only where equal names lie
    on both sides of the cut are they, and they alone, numbered."""
    name, _, equal, wanted = pivot(df, value, share)
    if name is None:
        return df.withColumn(out, F.lit(False))
    own = as_bytes(value)
    if equal == wanted:
        return df.withColumn(out, own <= F.lit(name))
    apart = df.filter(own != F.lit(name)).withColumn(out, own < F.lit(name))
    number = F.row_number().over(Window.partitionBy(own).orderBy(own))
    return apart.unionByName(df.filter(own == F.lit(name)).withColumn(out, number <= wanted))


def name_bins(df: DataFrame, value: Column) -> Column:
    """Bins in name order, none of them with more than a BINS-th of the rows unless these share one name."""
    rows = df.select(as_bytes(value).alias("_v"))
    ends = rows.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    most = max(1, ends["n"] // BINS)
    v = as_bytes(value)
    levels: list[tuple[int, list[bytes]]] = []
    width = len(os.path.commonprefix([bytes(ends["low"]), bytes(ends["high"])])) + STEP if ends["n"] else STEP
    while True:
        found = rows.groupBy(F.substring("_v", 1, width).alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        # at most BINS of them
        large = [bytes(r["bin"]) for r in found.filter((F.col("n") > most) & (F.col("low") != F.col("high"))).collect()]
        if not large:
            break
        levels.append((width, large))
        rows = rows.filter(F.substring("_v", 1, width).isin(large))
        width += STEP
    bins = F.substring(v, 1, width)
    for size, large in reversed(levels):
        bins = F.when(F.substring(v, 1, size).isin(large), bins).otherwise(F.substring(v, 1, size))
    return bins


def name_rank(df: DataFrame, value: Column, rank_col: str) -> DataFrame:
    """1-based rank of every row in the order of names: one shuffle of the rows by bin."""
    return ranked(df, [], [as_bytes(value)], name_bins(df, value), rank_col)
