"""The dataset commands with their usual defaults, each one Spark job from tables to tables.

Order of use: fetch_images, verify_images, delete_images, predict_lifestage, clean_dataset, split_dataset,
create_webdataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import boxes as bx
from fieldlens.functions.names import sample_key
from fieldlens.operators import checklists, filters, joins, matching, sampling, scoring
from fieldlens.plans.dataset import image_metadata, verified_metadata
from fieldlens.session import materialized
from fieldlens.sources import documents, files, images, jobs, shards, tables


def load_archive(spark: SparkSession, multimedia: str, occurrence: str) -> DataFrame:
    return image_metadata(*tables.dwca_scan(spark, multimedia, occurrence))


def _subset(metadata: DataFrame, keys: DataFrame | None, subset_key: str) -> DataFrame:
    return metadata if keys is None else filters.subset_by_keys(metadata, subset_key, keys)


def fetch_images(
    metadata: DataFrame, dataset_path: str, cache_path: str | None = None, subset_list: DataFrame | None = None,
    subset_key: str = "acceptedTaxonKey", num_images_per_category: int = 0, request_timeout: float = 30,
    random_seed: int = 42, num_workers: int | None = None, opener: files.Opener = files.url_opener,
) -> DataFrame:
    plan = _subset(metadata, subset_list, subset_key)
    if num_images_per_category > 0:
        plan = sampling.group_cap(plan, subset_key, num_images_per_category, seed=random_seed)
    return jobs.fetch_job(plan, dataset_path, cache_path, request_timeout, num_workers, opener)


def verify_images(
    metadata: DataFrame, dataset_path: str, subset_list: DataFrame | None = None, subset_key: str = "acceptedTaxonKey",
    resume_from: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verified metadata (files of known size), and the corrupted paths; results to resume from are carried on. Files of an
    unsupported format are in neither."""
    planned = filters.require_dataset_key(_subset(metadata, subset_list, subset_key))
    todo = planned
    if resume_from is not None:
        todo, _ = joins.resume_anti_join(planned, resume_from)
    # each file is decoded once, and the results outlive the deletion of broken files
    info = materialized(images.image_info(todo, dataset_path), "verification")
    good = info.filter(F.col("file_size") > 0).drop("unsupported")
    results = good if resume_from is None else resume_from.select(*good.columns).unionByName(good)
    return planned.join(results, "image_path"), info.filter("corrupted").select("image_path")


def delete_images(error_images: DataFrame, base_path: str | None = None) -> DataFrame:
    return jobs.delete_job(error_images.select(F.col(error_images.columns[0]).alias("filename")), base_path)


def predict_lifestage(
    verified: DataFrame, head: scoring.LinearHead, features: str = "features", predict_nan_life_stage: bool = True,
    earlier: DataFrame | None = None,
) -> DataFrame:
    rows = filters.null_lifestage_filter(verified) if predict_nan_life_stage else verified
    scored = scoring.batch_score(rows, head, "image_path", features)
    return scoring.append_scores(earlier, scored.withColumnRenamed("prediction", "life_stage_prediction"), "image_path")


def clean_dataset(
    metadata: DataFrame, verified: DataFrame, life_stage_predictions: DataFrame | None = None, remove_duplicate_url: bool = True,
    ignore_dataset_by_key: str | None = ",".join(filters.LOW_QUALITY_DATASETS), remove_tumbnails: bool = True, thumb_size: int = 64,
    remove_non_adults: bool = True,
) -> tuple[DataFrame, DataFrame]:
    rows = verified_metadata(metadata, verified, life_stage_predictions)
    return filters.clean_funnel(
        rows, remove_duplicate_url, ignore_dataset_by_key, thumb_size if remove_tumbnails else None, remove_non_adults
    )


def split_dataset(
    metadata: DataFrame, test_frac: float = 0.2, val_frac: float = 0.1, split_by_occurrence: bool = True,
    category_key: str = "acceptedTaxonKey", max_instances: int = 1000, min_instances: int = 0, random_seed: int = 42,
    row_order: str = "row_order",
) -> DataFrame:
    """Rows with ``split``; write them with ``write_table(..., partition_by=["split"])``."""
    split = sampling.stratified_split(
        metadata, category_key, test_frac, val_frac, split_by_occurrence, random_seed, row_order=row_order
    )
    if max_instances <= 0 and min_instances <= 0:
        return split
    return sampling.split_caps(
        materialized(split, "split"), category_key, max_instances, min_instances, test_frac, val_frac, seed=random_seed
    )


def create_webdataset(
    annotations: DataFrame, dataset_path: str, out_dir: str, label_column: str = "acceptedTaxonKey",
    image_path_column: str = "image_path", max_shard_size: int = shards.SHARD_BYTES, category_map: DataFrame | None = None,
    columns_to_json: str | None = None, detections: DataFrame | None = None, random_seed: int = 42,
) -> DataFrame:
    """Shards of the listed images (with ``file_size``) and their manifest.

    With ``detections`` (image, pos, conf, x, y, width, height) the crop rectangle of the best box goes into the
    sample's JSON for the loader to apply; pixels are not re-encoded here. A label without a category stops the command.
    """
    ids = category_map or checklists.category_map(annotations, label_column)
    rows, unmatched = joins.category_id_join(annotations, ids, label_column)
    unknown = unmatched.orderBy(label_column).limit(10).collect()
    if unknown:
        raise ValueError(f"no category for {label_column} " + ", ".join(f"{r[label_column]} ({r['rows']} rows)" for r in unknown))
    json_columns = columns_to_json.split(",") if columns_to_json else []
    if detections is not None:
        best = matching.best_detection(detections).withColumnRenamed("image", image_path_column).drop("pos", "conf")
        sized = rows.withColumnsRenamed({"width": "image_width", "height": "image_height"})
        rows = sized.join(best, image_path_column, "left")
        rows = rows.select("*", F.struct(*bx.square_crop_box("x", "y", "width", "height", "image_width", "image_height")).alias("crop"))
        json_columns = [*json_columns, "crop"]
    metadata = None
    if json_columns:
        rows = rows.withColumn("_json", documents.metadata_projection(*json_columns))
        metadata = "_json"
    rows = rows.withColumn("sample_key", sample_key(image_path_column))
    return shards.webdataset_sink(
        rows, out_dir, "file_size", "class_id", "sample_key", image_path=image_path_column, dataset_path=dataset_path,
        metadata=metadata, max_shard_size=max_shard_size, seed=random_seed,
    )
