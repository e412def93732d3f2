"""Counts and reports over images, crops and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def images_per_taxon(images: DataFrame, taxonomy: DataFrame, image_key: str, taxon_key: str = "speciesKey") -> DataFrame:
    """Images per species, genus and family of the checklist, 0 for taxa without images.

    Images are counted per key first; one grouping-sets pass over the small table gives the levels.
    """
    per_key = images.groupBy(F.col(image_key).alias(taxon_key)).agg(F.count("*").alias("_n"))
    counted = taxonomy.join(per_key, taxon_key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    sets = [[F.col("species")], [F.col("genus")], [F.col("family")]]
    levels = counted.groupingSets(sets, "species", "genus", "family").agg(
        F.sum("_n").alias("images"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 3, "species").when(F.col("_g") == 5, "genus").otherwise("family")
    return levels.select(level.alias("level"), F.coalesce("species", "genus", "family").alias("name"), "images")


def storage_stats(listing: DataFrame, path: str = "image_path", size: str = "file_size") -> DataFrame:
    """Dataset folders, files and bytes of a listing."""
    per_dir = listing.groupBy(F.substring_index(path, "/", 1).alias("_d")).agg(
        F.count("*").alias("_n"), F.sum(size).alias("_s")
    )
    return per_dir.agg(F.count("*").alias("datasets"), F.sum("_n").alias("images"), F.sum("_s").alias("bytes"))


def _levels(labels: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """(region, level, name) rows of each crop: a species counts at three levels, a genus at two, others at family."""
    rank = F.col("taxon_rank")
    known = labels.filter(rank != "ORDER")
    if excluded is not None:
        names = excluded.select(F.col(excluded.columns[0]).alias("label")).distinct().withColumn("_x", F.lit(True))
        known = known.join(names, "label", "left").filter(~((rank == "SPECIES") & F.col("_x").isNotNull())).drop("_x")
    family = F.struct(F.lit("FAMILY").alias("level"), F.col("family").alias("name"))
    genus = F.struct(F.lit("GENUS").alias("level"), F.col("genus").alias("name"))
    species = F.struct(F.lit("SPECIES").alias("level"), F.col("label").alias("name"))
    at = F.when(rank == "SPECIES", F.array(species, genus, family)).when(rank == "GENUS", F.array(genus, family))
    return known.select("region", F.explode(at.otherwise(F.array(family))).alias("_t")).select("region", "_t.*")


def taxon_level_counts(labels: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Crops and distinct taxa per region and level; ``labels`` carries genus and family."""
    per_name = _levels(labels, excluded).groupBy("region", "level", "name").agg(F.count("*").alias("n"))
    return per_name.groupBy("region", "level").agg(F.sum("n").alias("crops"), F.count("name").alias("taxa"))


def taxon_histogram(labels: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    return (
        _levels(labels, excluded).dropna(subset=["name"]).groupBy("level", "name").agg(F.count("*").alias("n"))
        .orderBy("level", F.desc("n"), "name")
    )
