"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.base import WORD, prepare, keep_rows, row_key
from fieldlens.session import materialized

#: No document is taken more often than this.
MAX_COPIES = 2
#: Pieces of a source's Pareto order; only the piece that the target falls into is sorted.
BUCKETS = 4096


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], budget_percent: int) -> DataFrame:
    """source, source_size, target: ``budget_percent`` of all words shared by weight, each source stopping at
    ``MAX_COPIES`` times its size and the excess reshared until none is above.

    Sources are ordered by code point, null last, and take the weights in turn. Works on one row per source:
    with the sources in the order of size over weight, those that stop come first, so running sums give the
    level at which the others share what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long"))
    by_stop = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = (
        per.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_w").over(from_here))
        # words times 100, so that the level is one division of whole numbers
        .withColumn("_left", F.col("_all") * budget_percent - F.col("_stopped") * (100 * MAX_COPIES))
        .withColumn("_level", F.col("_left") / (F.col("_open") * 100))
        .withColumn("_fits", F.col("_left").cast("decimal(38,0)") * F.col("_w") <= F.col("source_size").cast("decimal(38,0)") * F.col("_open") * (100 * MAX_COPIES))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_fits"), F.col("_stopped"))).over(everything))
    )
    stop = (F.col("source_size") * MAX_COPIES).cast("double")
    share = F.col("_level") * F.col("_w")
    return per.select("source", "source_size", F.when(share.isNull() | (share > stop), stop).otherwise(share).alias("target"))


def pareto_mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_percent: int = 150, seed: int = 20240601
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies_certain, inclusion: how many words the mix takes of each row.

    The expected number of copies of a row is proportional to the square root of its size, at most two, with the
    factor chosen per source so that expected words meet the target. Whole copies are certain; the remainders are
    inclusion probabilities p of a Pareto order sample: rows are ranked by (u/(1-u)) / (p/(1-p)) with u a hash of
    seed and doc_id, and taken in that order until the source's words come nearest to its target.

    Null or blank text has size 0 and takes nothing. Rows repeated under one doc_id share their draw; equal
    ranks are taken in the order of doc_id, size and a hash of the text. A null
    source is a source of its own. Budgets over two hundred percent give every row twice. An empty table gives
    an empty result. Other columns are ignored.
    """
    return _drawn(docs, weights, budget_percent, seed).drop("_id", "_th")


def _drawn(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_percent: int = 150, seed: int = 20240601) -> DataFrame:
    if not 0 <= budget_percent:
        raise ValueError("budget_percent must not be negative")
    prepare(docs.sparkSession)
    sizes = materialized(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), *row_key()), "mix-sizes"
    )
    targets = source_targets(sizes, weights, budget_percent)
    root = F.floor(F.sqrt("size"))

    # factor: over the distinct sizes of a source, largest first; the largest sizes may be worth two copies
    largest_first = Window.partitionBy("source").orderBy(F.desc("size"))
    before = largest_first.rowsBetween(Window.unboundedPreceding, -1)
    rest = largest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = (
        sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("_n"))
        .withColumn("_two", F.coalesce(F.sum(F.col("_n") * F.col("size")).over(before), F.lit(0)))
        .withColumn("_mass", F.sum(F.col("_n") * F.col("size") * root).over(rest))
        .withColumnRenamed("source", "_src")
    )
    cap = F.lit(float(MAX_COPIES))
    factors = (
        steps.join(targets, F.col("_src").eqNullSafe(F.col("source")))
        .withColumn("_f", (F.col("target") - F.col("_two") * MAX_COPIES) / F.col("_mass"))
        .groupBy("source")
        .agg(F.max_by("_f", F.when(F.col("_f") * root <= cap, F.col("size"))).alias("_f"))
        .withColumnRenamed("source", "_fsrc")
    )
    plan = targets.join(factors, F.col("source").eqNullSafe(F.col("_fsrc")), "left").drop("_fsrc").withColumnRenamed("source", "_src")

    copies = F.least(F.coalesce(F.col("_f") * root, cap), cap)
    whole = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.floor(copies + 1e-9))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
        .withColumn("copies_certain", whole.cast("long"))
        .withColumn("inclusion", F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.greatest(copies - F.col("copies_certain"), F.lit(0.0))))
        .withColumn("_odds", u / (1 - u))
        .withColumn("_rank", F.when(F.col("inclusion") > 0, F.col("_odds") * (1 - F.col("inclusion")) / F.col("inclusion")))
        .withColumn("_b", F.when(F.col("_rank").isNotNull(), F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(-1).cast("int"))
        .drop("_odds")
    )
    in_order = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # bucket -1 holds the rows without a draw; every bucket brings the certain words of its rows along
    pieces = (
        drawn.groupBy("source", "_b")
        .agg(
            F.sum(F.when(F.col("_b") >= 0, F.col("size")).otherwise(0)).alias("_words"),
            F.sum(F.col("copies_certain") * F.col("size")).alias("_sure"), F.first("target").alias("_target"),
        )
        .withColumn("_need", F.col("_target") - F.sum("_sure").over(Window.partitionBy("source")))
        .withColumn("_before", F.coalesce(F.sum("_words").over(in_order), F.lit(0)))
        .select(F.col("source").alias("_psrc"), F.col("_b").alias("_pb"), "_words", "_need", "_before")
    )
    placed = drawn.join(pieces, F.col("source").eqNullSafe(F.col("_psrc")) & (F.col("_b") == F.col("_pb"))).drop("_psrc", "_pb")
    cut = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_words") > F.col("_need")) & (F.col("_b") >= 0)
    all_in = (F.col("_b") >= 0) & (F.col("_before") + F.col("_words") <= F.col("_need"))
    inside = Window.partitionBy("source", "_b").orderBy("_rank", "doc_id", "size", "_th").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_before") + F.sum("size").over(inside)
    # the row that the target falls into is taken if that is nearer than stopping before it
    near = (end - F.col("_need")) <= (F.col("_need") - (end - F.col("size")))
    edge = placed.filter(cut).withColumn("_in", near)
    rest_rows = placed.filter(~cut).withColumn("_in", all_in)
    return edge.unionByName(rest_rows).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("copies_certain") + F.col("_in").cast("long"))).alias("taken"),
        "copies_certain", "inclusion", "_id", "_th",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    taken = _drawn(docs).filter("taken > 0")
    return keep_rows(docs, taken.withColumn("_n", (F.col("taken") / F.col("size")).cast("long")), copies="_n")
