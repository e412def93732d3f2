"""Exact positions and running totals that never put one key's rows into one task.

Two recipes, both in three steps (bucket totals, offsets over the small bucket table, rank inside a bucket):

* ``ranked`` for hash orders and any order with a cheap monotone bucket: lazy, one shuffle of the rows.
* ``globally_ordered`` for natural orders (score, name): the rows are range partitioned with a unique last
  sort key, so equal leading values still spread, and frozen with a reliable checkpoint before positions are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.session import ensure_checkpoint_dir


def hash_order(seed: int, *cols: str | Column) -> Column:
    """md5 of seed and id: a random order that does not depend on partitioning."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_bucket(hashed: Column, digits: int = 3) -> Column:
    """Leading hex digits; 16**digits buckets per key bound the offset table."""
    return F.substring(hashed, 1, digits)


def bucket_totals(df: DataFrame, keys: Sequence[str], bucket: Column, amount: Column | None = None) -> DataFrame:
    """Rows (or summed ``amount``) per key and bucket, the small table that offsets come from."""
    keyed = df.dropna(subset=list(keys)) if keys else df
    total = F.count("*") if amount is None else F.sum(amount)
    return keyed.groupBy(*keys, bucket.alias("_b")).agg(total.alias("_cnt"))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    rank_col: str = "rank",
    size_col: str | None = None,
    attach: Callable[[DataFrame], DataFrame] | None = None,
    totals: DataFrame | None = None,
    amount: Column | None = None,
) -> DataFrame:
    """1-based row number per key group in ``order``; ``bucket`` must be monotone with ``order``.

    With ``amount`` the running total of that column, own row included, takes the place of the row number.

    Rows with a null key are dropped, as a group-by on the key would. ``attach`` adds per-key columns to the
    offset table (columns ``keys``, ``_b``, ``_cnt``), so a hot key is never joined by itself. ``totals`` takes
    a ``bucket_totals`` table that is already there.
    """
    keys = list(keys)
    base = df.withColumn("_b", bucket)
    if keys:
        base = base.dropna(subset=keys)
    if totals is None:
        totals = bucket_totals(df, keys, bucket, amount)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*keys)))
    if attach is not None:
        offsets = attach(offsets)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    if amount is None:
        within = F.row_number().over(inside)
    else:
        within = F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        base.withColumn("_rn", within)
        .join(offsets.drop("_cnt"), [*keys, "_b"])
        .withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_b", "_off", "_rn")
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each key group in one scan; rows without a key are dropped.

    Each (key, salt) piece keeps its first ``n`` rows - cut per map task already, the limit being constant -
    and the key's own cut then sees at most ``n`` rows per salt value.
    """
    pieces = df.dropna(subset=list(keys)).withColumn("_s", salt)
    for by in ([*keys, "_s"], list(keys)):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        pieces = pieces.withColumn("_r", place).filter(F.col("_r") <= n).drop("_r")
    return pieces.drop("_s")


def globally_ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in a total order, frozen, with ``_part`` and ``_pos`` locating each row."""
    ensure_checkpoint_dir(df.sparkSession)
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    return laid.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """1-based position of every row in a total order over the whole table."""
    laid = globally_ordered(df, order)
    totals = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        laid.join(offsets, "_part")
        .withColumn(rank_col, F.col("_off") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_off")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running totals per key group in a natural order, plus ``_part``/``_pos`` for later passes."""
    keys = list(keys)
    laid = globally_ordered(df, [*[F.col(k) for k in keys], *order])
    totals = laid.groupBy(*keys, "_part").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.select("*", *[F.sum(e).over(inside).alias(f"_i_{n}") for n, e in sums.items()])
    out = out.join(offsets, [*keys, "_part"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_o_{n}") + F.col(f"_i_{n}"))
    return out.drop(*[f"_o_{n}" for n in sums], *[f"_i_{n}" for n in sums])


def suffix_maxima(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Running maxima of columns (out: column) from the end of each key group over rows placed by ``running_sums``."""
    keys = list(keys)
    peaks = df.groupBy(*keys, "_part").agg(*[F.max(v).alias(f"_m_{o}") for o, v in values.items()])
    # read backwards: a frame that only grows is one pass, one that shrinks is recomputed for every row
    after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later = peaks.select(*keys, "_part", *[F.max(f"_m_{o}").over(after).alias(f"_l_{o}") for o in values])
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
    own = df.select("*", *[F.max(v).over(inside).alias(f"_o_{o}") for o, v in values.items()]).join(later, [*keys, "_part"])
    return own.withColumns({o: F.greatest(f"_o_{o}", f"_l_{o}") for o in values}).drop(*[f"{p}{o}" for p in ("_o_", "_l_") for o in values])


def suffix_max(df: DataFrame, keys: Sequence[str], value: str, out_col: str) -> DataFrame:
    return suffix_maxima(df, keys, {out_col: value})
