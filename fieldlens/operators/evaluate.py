"""Classifier metrics: one narrow evaluation table, then partial aggregates over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import arrays
from fieldlens.functions.arrays import ClassTaxonomy

LEVELS = ("SPECIES", "GENUS", "FAMILY")


def evaluation_table(logits: DataFrame, taxonomy: ClassTaxonomy, row_id: str = "vec_id") -> DataFrame:
    """(row, level, gt, gt_rank, pred, conf) at species, genus and family; gt_rank 0 = not predicted.

    Computed inside each row: no shuffle between the logits scan and the metrics' own aggregates.
    """
    probs = logits.select(row_id, "label", arrays.softmax("logits").alias("probs"))
    ranked = {
        "SPECIES": F.transform(
            arrays.top_k("probs"),
            lambda t: F.struct(taxonomy.name_array("SPECIES")[t["i"]].alias("name"), (-t["neg_p"]).alias("conf")),
        ),
        "GENUS": arrays.taxon_rollup("probs", taxonomy, "GENUS"),
        "FAMILY": arrays.taxon_rollup("probs", taxonomy, "FAMILY"),
    }
    entries = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), taxonomy.name_array(lv)[F.col("label")].alias("gt"), ranked[lv].alias("ranked"))
            for lv in LEVELS
        ]
    )
    flat = probs.select(row_id, F.explode(entries).alias("e")).select(row_id, "e.*")
    return flat.select(
        row_id,
        "level",
        "gt",
        F.array_position(F.col("ranked.name"), F.col("gt")).alias("gt_rank"),
        F.col("ranked")[0]["name"].alias("pred"),
        F.col("ranked")[0]["conf"].alias("conf"),
    )


def _hit(k: int) -> Column:
    return F.when((F.col("gt_rank") > 0) & (F.col("gt_rank") <= k), 1).otherwise(0)


def topk_micro_accuracy(table: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), by: Sequence[str] = ("level",)) -> DataFrame:
    hits = [F.round(F.avg(_hit(k)) * 100, 2).alias(f"top{k}") for k in ks]
    return table.groupBy(*by).agg(F.count("*").alias("total"), *hits)


def class_accuracy(table: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    hits = [F.sum(_hit(k)).alias(f"correct{k}") for k in ks]
    return table.groupBy("level", "gt").agg(F.count("*").alias("total"), *hits)


def mean_of_rounded(percent: Column) -> Column:
    """Mean of two-decimal percents, summed as whole hundredths so that row order cannot move a tie."""
    hundredths = F.round(F.round(percent, 2) * 100).cast("long")
    return F.round(F.sum(hundredths) / F.count("*")) / 100


def macro_accuracy(table: DataFrame, ks: Sequence[int] = (1, 5), round_per_class: bool = False) -> DataFrame:
    """Unweighted mean of class accuracies; optionally each class is rounded to 2 decimals first."""
    def mean(k: int) -> Column:
        acc = F.col(f"correct{k}") / F.col("total") * 100
        return (mean_of_rounded(acc) if round_per_class else F.round(F.avg(acc), 2)).alias(f"macro_top{k}")

    return class_accuracy(table, ks).groupBy("level").agg(F.count("*").alias("classes"), *[mean(k) for k in ks])


def per_class_accuracy(preds: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Correct, total and accuracy per true class, best first; ``synonyms`` (pred, synonym) count as correct."""
    correct = F.col("gt") == F.col("pred")
    if synonyms is not None:
        preds = preds.join(synonyms, "pred", "left")
        correct = correct | F.coalesce(F.col("gt") == F.col("synonym"), F.lit(False))
    return (
        preds.groupBy("gt").agg(F.count_if(correct).alias("correct"), F.count("*").alias("total"))
        .withColumn("accuracy", F.round(F.col("correct") / F.col("total") * 100, 2))
        .orderBy(F.desc("accuracy"), F.desc("total"), "gt")
    )


def long_tail_accuracy(classes: DataFrame, train_counts: DataFrame, key: str = "gt") -> DataFrame:
    """Mean class accuracy for few (< 20), medium (<= 100) and many training images; unknown classes left out."""
    acc = F.col("correct") / F.col("total") * 100
    n = F.col("n_train")
    bucket = F.when(n < 20, "few").when(n <= 100, "medium").otherwise("many")
    return (
        classes.join(train_counts, key).groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("classes"), mean_of_rounded(acc).alias("accuracy"))
    )


def train_count_bin(n: str | Column) -> Column:
    # fixed values
    bins = [(5, "0-4"), (10, "5-9"), (20, "10-19"), (50, "20-49"), (100, "50-99"), (200, "100-199"), (500, "200-499")]
    n = F.col(n) if isinstance(n, str) else n
    out = None
    for upper, name in bins:
        out = F.when(n < upper, name) if out is None else out.when(n < upper, name)
    return out.when(n <= 1000, "500-1K").otherwise("1K+")


def binned_accuracy_boxplot(classes: DataFrame, train_counts: DataFrame, key: str = "gt") -> DataFrame:
    """Accuracy quartiles per bin of training images.

    Class accuracies have two decimals, so they are counted per value first and the percentiles read at most
    10001 weighted values per bin.
    """
    joined = classes.join(train_counts, key).select(
        train_count_bin("n_train").alias("bin"), F.round(F.col("correct") / F.col("total") * 100, 2).alias("acc")
    )
    values = joined.groupBy("bin", "acc").agg(F.count("*").alias("w"))
    q = F.percentile("acc", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("w"))
    names = ["min", "q1", "median", "q3", "max"]
    return values.groupBy("bin").agg(F.sum("w").alias("classes"), q.alias("q")).select(
        "bin", "classes", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(names)]
    )


def binary_outcome(gt: str = "gt", pred: str = "pred", positive: str = "Moth") -> Column:
    is_gt, is_pred = F.col(gt) == positive, F.col(pred) == positive
    return F.when(is_gt & is_pred, "TP").when(is_gt, "FN").when(is_pred, "FP").otherwise("TN")


def binary_metrics(preds: DataFrame, positive: str = "Moth") -> DataFrame:
    """Counts, accuracy, precision, recall in percent, and F1 from the rounded values."""
    o = binary_outcome(positive=positive)
    counts = preds.agg(*[F.count_if(o == name).alias(name.lower()) for name in ("TP", "TN", "FP", "FN")])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def pct(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(a, b) * 100, 2)

    total = tp + tn + fp + fn
    scored = counts.select(
        "*", total.alias("total"), pct(tp + fn, total).alias("moth_share"), pct(tn + fp, total).alias("nonmoth_share"),
        pct(tp + tn, total).alias("accuracy"), pct(tp, tp + fp).alias("precision"), pct(tp, tp + fn).alias("recall"),
    )
    f1 = F.round(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 2)
    return scored.withColumn("f1", f1)


def confidence_histogram(preds: DataFrame, conf: str = "conf", width: int = 10) -> DataFrame:
    """Predictions per outcome and confidence bin on 0-100; 100 belongs to the last bin."""
    last = 100 // width - 1
    low = F.least(F.floor(F.col(conf) / width), F.lit(last)) * width
    return preds.groupBy(binary_outcome().alias("outcome"), low.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def accuracy_vs_confidence(table: DataFrame) -> DataFrame:
    """Correct, kept and rejected predictions at thresholds 10..90; kept means floor(100 * conf) > threshold.

    Counted per whole percent first, so the nine thresholds meet at most 101 rows per level and outcome.
    """
    percent = F.floor(F.col("conf") * 100)
    counts = table.groupBy("level", percent.alias("pc"), (F.col("gt") == F.col("pred")).alias("ok")).agg(
        F.count("*").alias("n")
    )
    spread = counts.select("*", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(10))).alias("threshold"))
    kept = F.col("pc") > F.col("threshold")
    sums = spread.groupBy("level", "threshold").agg(
        F.coalesce(F.sum(F.when(kept & F.col("ok"), F.col("n"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("conf_total"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("reject"),
        F.sum("n").alias("moths_total"),
    )
    return sums.select(
        "*",
        F.round(F.try_divide(F.col("correct"), F.col("conf_total")) * 100, 2).alias("accuracy"),
        F.round(F.col("reject") / F.col("moths_total") * 100, 2).alias("rejection"),
    )


def confusion_matrix(table: DataFrame) -> DataFrame:
    return table.groupBy("level", "gt", "pred").agg(F.count("*").alias("n"))


def cross_entropy_metrics(logits: DataFrame, weight_on_order: float = 0.5, label_smoothing: float = 0.1) -> DataFrame:
    """Exact row means of the order, binary (class 0 against the rest), weighted and smoothed losses."""
    z = F.col("logits")
    lse = arrays.log_sum_exp(z)
    nll = lse - z[F.col("label")]
    binary = arrays.merge_to_binary_probs(arrays.softmax(z))
    rows = logits.select(
        nll.alias("order_loss"),
        (-F.log(binary[F.when(F.col("label") == 0, 0).otherwise(1)])).alias("binary_loss"),
        (lse - arrays.array_sum(z) / F.size(z)).alias("uniform_loss"),
    )
    means = rows.agg(*[F.avg(c).alias(c) for c in ("order_loss", "binary_loss", "uniform_loss")])
    w, s = weight_on_order, label_smoothing
    order, bin_, uni = F.col("order_loss"), F.col("binary_loss"), F.col("uniform_loss")
    return means.select(
        F.round(order, 6).alias("order_loss"),
        F.round(bin_, 6).alias("binary_loss"),
        F.round(w * order + (1 - w) * bin_, 6).alias("weighted_loss"),
        F.round((1 - s) * order + s * uni, 6).alias("smoothed_loss"),
    )
