"""Calibration error and temperature tuning."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import arrays

#: An optimum of 1/T below this counts as none: the labels do not follow the logits at any temperature.
MIN_BETA = 1e-6


def reliability_rows(logits: DataFrame, bins: int = 10, temperature: float = 1.0) -> DataFrame:
    """Share, mean confidence and accuracy per confidence bin (lo, hi]."""
    z = arrays.temperature_scale("logits", temperature) if temperature != 1.0 else F.col("logits")
    scored = logits.select("label", F.array_min(F.transform(arrays.softmax(z), lambda p, i: F.struct((-p).alias("n"), i.alias("i")))).alias("best"))
    conf = -F.col("best.n")
    rows = scored.select(
        F.ceil(conf * bins).cast("int").alias("bin"), conf.alias("conf"),
        (F.col("best.i") == F.col("label")).cast("int").alias("ok"),
    )
    total = rows.agg(F.count("*")).scalar()
    return (
        rows.filter(F.col("bin") > 0).groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("conf").alias("avg_conf"), F.avg("ok").alias("accuracy"))
        .withColumn("share", F.col("n") / total)
    )


def expected_calibration_error(logits: DataFrame, bins: int = 10, temperature: float = 1.0) -> DataFrame:
    gap = F.col("share") * F.abs(F.col("avg_conf") - F.col("accuracy"))
    return reliability_rows(logits, bins, temperature).agg(F.round(F.sum(gap), 3).alias("ece"))


def _moments(beta: Column) -> tuple[Column, Column, Column]:
    """Row loss, slope and curvature of the negative log likelihood in beta = 1 / T."""
    z = F.col("logits")
    scaled = F.transform(z, lambda v: v * beta)
    probs = arrays.softmax(scaled)
    mean = arrays.array_sum(F.zip_with(F.col("p"), z, lambda p, v: p * v))
    square = arrays.array_sum(F.zip_with(F.col("p"), z, lambda p, v: p * v * v))
    return probs, mean, square


def tune_temperature(logits: DataFrame, initial_t: float = 1.5, max_steps: int = 200, tol: float = 1e-10) -> float:
    """Temperature minimising the mean negative log likelihood, four decimals.

    Newton steps on 1/T, where the loss is convex; each step is one aggregate that brings two numbers back. The
    signs of the slopes bracket the optimum, and a step out of the bracket halves it (or doubles 1/T while there
    is no upper end). Raises where there is no row, or no finite optimum is reached.
    """
    held = logits.select("logits", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta, low, high = 1.0 / initial_t, 0.0, math.inf
        for _ in range(max_steps):
            probs, mean, square = _moments(F.lit(beta))
            step = (
                held.withColumn("p", probs).select(mean.alias("m"), square.alias("s"), F.col("logits")[F.col("label")].alias("zy"))
                .agg(F.avg(F.col("m") - F.col("zy")).alias("slope"), F.avg(F.col("s") - F.col("m") * F.col("m")).alias("curve"))
                .first()
            )
            slope, curve = step["slope"], step["curve"]
            if slope is None:
                raise ValueError("no labelled rows to tune a temperature on")
            low, high = (low, beta) if slope > 0 else (beta, high)
            after = beta - slope / curve if curve > 0 else (beta if slope == 0 else math.inf)
            if abs(after - beta) < tol and beta > MIN_BETA:
                return round(1.0 / after, 4)
            if not low < after < high:
                after = (low + high) / 2 if high < math.inf else beta * 2
            beta = after
        raise ArithmeticError(f"temperature not found in {max_steps} steps; the loss has no finite optimum near 1/T = {beta}")
    finally:
        held.unpersist()


def calibration_report(logits: DataFrame, temperature: float) -> DataFrame:
    """Loss and calibration error before and after scaling."""
    def nll(t: float) -> Column:
        z = arrays.temperature_scale("logits", t)
        return arrays.log_sum_exp(z) - F.col("logits")[F.col("label")] / t

    losses = logits.agg(
        F.round(F.avg(nll(1.0)), 6).alias("nll_before"), F.round(F.avg(nll(temperature)), 6).alias("nll_after")
    )
    return losses.select(
        F.lit(float(temperature)).alias("temperature"),
        "*",
        expected_calibration_error(logits).scalar().alias("ece_before"),
        expected_calibration_error(logits, temperature=temperature).scalar().alias("ece_after"),
    )
