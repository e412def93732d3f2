"""Caps, splits and seeded shuffles. All draws follow md5(seed|id), so they do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.joins import first_per_occurrence
from fieldlens.operators.ordering import bucket_totals, ensure_checkpoint_dir, first_n, hash_bucket, hash_order, ranked
from fieldlens.operators.selection import name_rank, up_to


def _hashed(df: DataFrame, seed: int, unit: str) -> DataFrame:
    return df.withColumn("_h", hash_order(seed, unit))


def group_cap(df: DataFrame, key: str, n: int, unit: str = "image_path", seed: int = 42) -> DataFrame:
    """At most ``n`` random rows per key; rows without a key are dropped."""
    h = F.col("_h")
    # the order is led by the first digits, so the last two spread every part of it
    return first_n(_hashed(df, seed, unit), [key], [h, F.col(unit)], F.substring(h, 31, 2), n).drop("_h")


def half_split(df: DataFrame, order: str) -> DataFrame:
    """``half`` = 1 for the first floor(n/2) rows in the order of names, 2 for the rest."""
    return up_to(df, F.col(order), 0.5, "_first").withColumn("half", F.when(F.col("_first"), 1).otherwise(2)).drop("_first")


def systematic_sample(df: DataFrame, order: str, rate: int) -> DataFrame:
    """Every ``rate``-th row of the list sorted by name, starting with the first."""
    return name_rank(df, F.col(order), "_r").filter((F.col("_r") - 1) % rate == 0).drop("_r")


def shuffle(df: DataFrame, unit: str = "image_path", seed: int = 42) -> DataFrame:
    """Seeded random ``position`` (from 1) for every row; sort on it, or range partition by it, to use it."""
    h = F.col("_h")
    return ranked(_hashed(df, seed, unit), [], [h, F.col(unit)], hash_bucket(h, 4), "position").drop("_h")


def random_pair_split(df: DataFrame, unit: str, train_percent: float = 80, seed: int = 42) -> DataFrame:
    """Exactly int(percent/100 * n) random rows to train, the rest to val."""
    drawn = F.concat(hash_order(seed, unit), F.coalesce(F.col(unit).cast("string"), F.lit("")))
    rows = up_to(df, drawn, train_percent / 100, "_train")
    return rows.withColumn("split", F.when(F.col("_train"), "train").otherwise("val")).drop("_train")


def ratio_split(
    df: DataFrame,
    key: str,
    unit: str = "image_path",
    train: float = 0.7,
    val: float = 0.1,
    test: float = 0.2,
    min_samples: int = 5,
    seed: int = 42,
    rounded: bool = False,
) -> DataFrame:
    """Per-class split by ratio in a random order.

    Default: train and test sizes cut to whole rows, val takes the remainder, small classes go to test whole.
    ``rounded``: train and val sizes rounded half to even, test takes the remainder, no small-class rule.
    """
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    h, n, r = F.col("_h"), F.col("_n"), F.col("_r")
    placed = ranked(_hashed(df, seed, unit), [key], [h, F.col(unit)], hash_bucket(h), "_r", "_n")
    if rounded:
        n_train, n_val = F.bround(n * F.lit(train)), F.bround(n * F.lit(val))
        split = F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")
    else:
        n_train, n_test = F.floor(n * F.lit(train)), F.floor(n * F.lit(test))
        split = (
            F.when(n < min_samples, "test").when(r <= n_train, "train").when(r <= n - n_test, "val").otherwise("test")
        )
    return placed.withColumn("split", split).drop("_h", "_n", "_r")


def _quotas(classes: DataFrame, category: str, size: str, eligible, fraction: float, out: str) -> DataFrame:
    """Largest-remainder share of ceil(fraction * total) among eligible classes, in whole numbers."""
    sizes = F.when(eligible, F.col(size)).otherwise(0)
    total = classes.agg(F.sum(sizes)).scalar()
    wanted = F.ceil(F.lit(fraction) * total)
    shares = (
        classes.withColumn("_e", eligible & (F.col(size) > 0))
        .withColumn("_tot", total.cast("long"))
        .withColumn("_want", wanted.cast("long"))
        .withColumn("_base", F.when(F.col("_e"), F.expr(f"(cast(_want AS decimal(38,0)) * {size}) div _tot")).otherwise(F.lit(0).cast("long")))
        .withColumn("_rem", F.when(F.col("_e"), F.expr(f"cast((cast(_want AS decimal(38,0)) * {size}) % _tot AS bigint)")).otherwise(F.lit(-1).cast("long")))
    )
    given = shares.agg(F.sum("_base")).scalar()
    bucket = F.when(F.col("_e"), F.expr("(cast(_tot - _rem AS decimal(38,0)) * 4096) div _tot")).otherwise(F.lit(8192).cast("long"))
    placed = ranked(shares, [], [F.col("_rem").desc(), F.col(category)], bucket, "_r")
    extra = F.when(F.col("_e") & (F.col("_r") <= F.col("_want") - given), 1).otherwise(0)
    return placed.withColumn(out, F.col("_base") + extra).drop("_e", "_tot", "_want", "_base", "_rem", "_r")


def stratified_split(
    df: DataFrame,
    category: str = "acceptedTaxonKey",
    test_frac: float = 0.2,
    val_frac: float = 0.1,
    by_occurrence: bool = True,
    seed: int = 42,
    occurrence: str = "coreid",
    row_id: str = "image_path",
    row_order: str = "row_order",
) -> DataFrame:
    """Rows with ``split``: test and val drawn proportionally per class, whole occurrences together, rest train.

    A class takes part in test (val) from ceil(1/test_frac) (ceil(1/val_frac)) units on. One shuffle ranks the
    units of a class by hash; the first quota goes to test and the next to val.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if by_occurrence:
        unit = occurrence
        units = first_per_occurrence(df.select(unit, category, row_order), row_order, unit).select(unit, category)
    else:
        unit = row_id
        units = df.select(unit, category)
    h, r = F.col("_h"), F.col("_r")
    keyed = _hashed(units, seed, unit)
    # counts per class and hash bucket, frozen: class sizes, quotas and rank offsets all read this small table
    totals = bucket_totals(keyed, [category], hash_bucket(h)).checkpoint()
    classes = totals.groupBy(category).agg(F.sum("_cnt").alias("n"))
    with_test = _quotas(classes, category, "n", F.col("n") >= math.ceil(1 / test_frac), test_frac, "q_test")
    left = with_test.withColumn("m", F.col("n") - F.col("q_test"))
    quotas = _quotas(left, category, "m", F.col("n") >= math.ceil(1 / val_frac), val_frac / (1 - test_frac), "q_val")
    share = quotas.select(category, "q_test", "q_val").checkpoint()
    placed = ranked(
        keyed, [category], [h, F.col(unit)], hash_bucket(h), "_r", totals=totals,
        attach=lambda o: o.join(share, category),
    )
    drawn = placed.filter(r <= F.col("q_test") + F.col("q_val")).select(
        unit, F.when(r <= F.col("q_test"), "test").otherwise("val").alias("split")
    )
    return df.join(drawn, unit, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_caps(
    df: DataFrame,
    category: str,
    max_instances: int = 1000,
    min_instances: int = 0,
    test_frac: float = 0.2,
    val_frac: float = 0.1,
    unit: str = "image_path",
    seed: int = 42,
) -> DataFrame:
    """Cap each class per split, then drop classes short of train rows; caps come first."""
    cap = (
        F.when(F.col("split") == "train", max_instances)
        .when(F.col("split") == "val", int(max_instances * val_frac))
        .otherwise(int(max_instances * test_frac))
    ) if max_instances > 0 else F.lit(None).cast("int")
    h = F.col("_h")

    def survivors(offsets: DataFrame) -> DataFrame:
        # train rows of the class after its cap, known from the totals alone
        whole = F.sum(F.when(F.col("split") == "train", F.col("_cnt"))).over(Window.partitionBy(category))
        train = F.least(F.coalesce(whole, F.lit(0)), F.lit(max_instances)) if max_instances > 0 else whole
        return offsets.withColumn("_train", train).filter(F.col("_train") >= min_instances)

    placed = ranked(
        _hashed(df, seed, unit), ["split", category], [h, F.col(unit)], hash_bucket(h), "_r",
        attach=survivors if min_instances > 0 else None,
    )
    out = placed.filter(F.coalesce(F.col("_r") <= cap, F.lit(True))).select(*df.columns)
    if min_instances <= 0:
        out = out.unionByName(df.filter(F.col(category).isNull()))
    return out


def taxon_sample(
    df: DataFrame, column: str, taxon: str, n: int, probability: float = 0.5, unit: str = "crop_id", seed: int = 42
) -> DataFrame:
    """Up to ``n`` rows of a taxon, each passing a coin with the given probability, in hash order."""
    h = hash_order(seed, unit)
    coin = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.filter((F.col(column) == taxon) & (coin < probability)).orderBy(h, unit).limit(n)
