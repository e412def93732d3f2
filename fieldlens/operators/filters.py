"""Row filters with the null rules of the cleaning jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
BUTTERFLY_FAMILIES = (
    "Hesperiidae",
    "Lycaenidae",
    "Nymphalidae",
    "Papilionidae",
    "Pieridae",
    "Riodinidae",
    "Hedylidae",
)
# fixed values
ADULT_STAGES = ("Adult", "Imago")
# fixed values
LOW_QUALITY_DATASETS = (
    "f3130a8a-4508-42b4-9737-fbda77748438",
    "4bfac3ea-8763-4f4b-a71a-76a6f5f243d3",
    "7e380070-f762-11e1-a439-00145eb45e9a",
)


def _true(cond: Column) -> Column:
    """The condition, with unknown counted as false."""
    return F.coalesce(cond, F.lit(False))


def subset_by_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Keep rows whose key is listed; ``keys`` has one column. The join side is chosen by measured size."""
    listed = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return df.join(listed, column, "left_semi")


def require_dataset_key(df: DataFrame) -> DataFrame:
    return df.filter(F.col("datasetKey").isNotNull())


def is_ignored_dataset(datasets: Sequence[str] | str) -> Column:
    names = datasets.split(",") if isinstance(datasets, str) else list(datasets)
    return _true(F.col("datasetKey").isin(names))


def ignore_dataset(df: DataFrame, datasets: Sequence[str] | str = LOW_QUALITY_DATASETS) -> DataFrame:
    return df.filter(~is_ignored_dataset(datasets))


def is_thumbnail(thumb_size: int = 64) -> Column:
    return _true(F.col("width") < thumb_size) | _true(F.col("height") < thumb_size)


def remove_thumbnails(df: DataFrame, thumb_size: int = 64) -> DataFrame:
    return df.filter(~is_thumbnail(thumb_size))


def is_adult() -> Column:
    return _true(F.col("lifeStage").isin(*ADULT_STAGES)) | _true(F.col("life_stage_prediction") == "Adult")


def remove_non_adults(df: DataFrame) -> DataFrame:
    return df.filter(is_adult())


def null_lifestage_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lifeStage").isNull())


def checklist_filter(
    df: DataFrame, families: Sequence[str] = BUTTERFLY_FAMILIES, rank: str = "rank", family: str = "family"
) -> DataFrame:
    """Species rows outside the listed families; a missing family is kept."""
    return df.filter((F.col(rank) == "SPECIES") & ~_true(F.col(family).isin(list(families))))


def drop_all_duplicates(df: DataFrame, column: str = "identifier") -> DataFrame:
    """Rows whose value is unique in the table; nulls equal each other.

    One aggregate reads the rows once: a value that is counted once has one row, which is the first one. Copies of a value
    are combined before the shuffle.
    """
    others = [c for c in df.columns if c != column]
    once = df.groupBy(f"`{column}`").agg(F.count("*").alias("__n"), *[F.first(f"`{c}`").alias(c) for c in others]).filter("__n = 1")
    return once.select(*[f"`{c}`" for c in df.columns])


def clean_funnel(
    df: DataFrame,
    remove_duplicate_url: bool = True,
    ignored: Sequence[str] | str | None = LOW_QUALITY_DATASETS,
    thumb_size: int | None = 64,
    adults_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows, and (step, rule, removed) counts in rule order, from one aggregate of the rows by URL.

    A URL that is counted once has one row, which is the first one. Rows that another rule removes keep no other columns,
    and copies of one URL are combined before the shuffle.
    """
    key = "identifier"
    rest = F.lit(None).cast("string")
    if adults_only:
        rest = F.when(~is_adult(), F.lit("non_adult")).otherwise(rest)
    if thumb_size is not None:
        rest = F.when(is_thumbnail(thumb_size), F.lit("thumbnail")).otherwise(rest)
    if ignored is not None:
        rest = F.when(is_ignored_dataset(ignored), F.lit("dataset")).otherwise(rest)
    if remove_duplicate_url:
        ruled = df.withColumn("_rest", rest)
        kept = [F.first(F.when(F.col("_rest").isNull(), F.col(f"`{c}`"))).alias(c) for c in df.columns if c != key]
        by_url = ruled.groupBy(key).agg(F.count("*").alias("_n"), F.first("_rest").alias("_rest"), *kept)
        marked = by_url.withColumn("_rule", F.when(F.col("_n") > 1, F.lit("duplicate_url")).otherwise(F.col("_rest")))
    else:
        marked = df.withColumn("_rule", rest).withColumn("_n", F.lit(1).cast("long"))
    clean = marked.filter(F.col("_rule").isNull()).select(*[f"`{c}`" for c in df.columns])
    step = (
        F.when(F.col("_rule") == "duplicate_url", 1).when(F.col("_rule") == "dataset", 2)
        .when(F.col("_rule") == "thumbnail", 3).when(F.col("_rule") == "non_adult", 4).otherwise(5)
    )
    report = (
        marked.groupBy(step.alias("step"), F.coalesce("_rule", F.lit("kept")).alias("rule"))
        .agg(F.sum("_n").alias("images"))
    )
    return clean, report


def small_box_filter(boxes: DataFrame, min_side: float = 10) -> DataFrame:
    """Boxes with both sides at least ``min_side``; images left without boxes are gone with their rows."""
    return boxes.filter((F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side))


def small_crop_filter(
    df: DataFrame, min_dim: int, width="w", height="h", image_width="image_width", image_height="image_height"
) -> DataFrame:
    """Drop a crop only when both pixel sides, cut to whole pixels, are below the limit."""
    w = F.floor(F.col(width) * F.col(image_width))
    h = F.floor(F.col(height) * F.col(image_height))
    return df.filter(~((w < min_dim) & (h < min_dim)))


def mask_area_filter(masks: DataFrame, lower: float = 0.0002, upper: float = 0.25) -> DataFrame:
    """Masks within the area share, as corner boxes with score = min(1, sqrt(iou * stability))."""
    frame = F.col("image_width") * F.col("image_height")
    keep = ~((F.col("area") > frame * upper) | (F.col("area") < frame * lower))
    return masks.filter(keep).select(
        "image",
        "mask_id",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        (F.col("x") + F.col("w")).alias("x2"),
        (F.col("y") + F.col("h")).alias("y2"),
        F.lit(1).alias("label"),
        F.least(F.lit(1.0), F.sqrt(F.col("predicted_iou") * F.col("stability"))).alias("score"),
    )


def preds_to_ground_truth(preds: DataFrame, score_thr: float) -> tuple[DataFrame, DataFrame]:
    """Boxes with score >= threshold as labels, and the images that end up with none."""
    kept = preds.filter(F.col("score") >= score_thr)
    per_image = preds.groupBy("image").agg(F.max("score").alias("_best"))
    dropped = per_image.filter(~_true(F.col("_best") >= score_thr)).select("image")
    return kept.drop("score"), dropped


def score_filter(preds: DataFrame, score_thr: float) -> DataFrame:
    return preds.filter(F.col("score") > score_thr)
