"""Collection, cleaning and counting pipelines over the archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.names import image_path
from fieldlens.operators import filters, joins
from fieldlens.operators.ordering import hash_bucket


def image_metadata(media: DataFrame, occurrence: DataFrame) -> DataFrame:
    """One row per image with its occurrence, index within it and path."""
    if "ord" in media.columns:
        rows = joins.indexed_images(media, occurrence, [F.col("ord")], hash_bucket(F.col("ord")))
    else:
        rows = joins.indexed_images(media, occurrence)
    return rows.withColumn("image_path", image_path())


def verified_metadata(images: DataFrame, verified: DataFrame, predictions: DataFrame | None) -> DataFrame:
    return joins.lifestage_join(joins.verified_join(verified, images), predictions)


def flagship(t) -> DataFrame:
    """Join, index, verify, clean, then count the surviving images per taxon."""
    t = t.frozen("identifier", "coreid", "acceptedTaxonKey")
    rows = verified_metadata(t.images, t.verified, t.lifestage_predictions)
    clean, _ = filters.clean_funnel(rows, ignored="ds3,ds5")
    return (
        clean.filter(F.col("acceptedTaxonKey").isNotNull())
        .groupBy("acceptedTaxonKey")
        .agg(F.count("*").alias("images"), F.countDistinct("coreid").alias("occurrences"))
    )
