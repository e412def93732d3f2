"""Archive, cleaning and dataset-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.catalog import query
from fieldlens.functions import names
from fieldlens.operators import filters, joins
from fieldlens.operators.ordering import hash_bucket
from fieldlens.plans import dataset
from fieldlens.plans.fixtures import with_views

IMAGES = with_views("images")
CLEAN_INPUT = with_views("images", "verified", "lifestage_predictions") + """,
 rows_ AS MATERIALIZED (SELECT v.width, v.height, i.*, p.life_stage_prediction FROM verified v JOIN images i ON v.image_path = i.image_path
           LEFT JOIN lifestage_predictions p ON p.image_path = i.image_path)"""
RULES = CLEAN_INPUT + """,
 ruled AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER (PARTITION BY identifier) > 1 THEN 'duplicate_url'
      WHEN datasetKey IN ('ds3', 'ds5') THEN 'dataset'
      WHEN coalesce(width < 64, FALSE) OR coalesce(height < 64, FALSE) THEN 'thumbnail'
      WHEN NOT (coalesce(lifeStage IN ('Adult', 'Imago'), FALSE) OR coalesce(life_stage_prediction = 'Adult', FALSE)) THEN 'non_adult'
      ELSE 'kept' END AS rule FROM rows_)"""


def _rows(t):
    t = t.frozen("identifier", "coreid", "acceptedTaxonKey")
    return dataset.verified_metadata(t.images, t.verified, t.lifestage_predictions)


@query("occurrence_media_join", with_views("media", "occurrence") + """
SELECT m.coreid, m.identifier, o.datasetKey, o.acceptedTaxonKey, o.lifeStage FROM media m JOIN occurrence o ON m.coreid = o.id""")
def occurrence_media_join(t):
    return joins.occurrence_media_join(t.media, t.occurrence).select(
        "coreid", "identifier", "datasetKey", "acceptedTaxonKey", "lifeStage")


@query("cumcount", with_views("media") + """
SELECT coreid, ord, row_number() OVER (PARTITION BY coreid ORDER BY ord) - 1 AS cnt FROM media""")
def cumcount(t):
    return joins.cumcount(t.media, order=[F.col("ord")], bucket=hash_bucket(F.col("ord"))).select("coreid", "ord", "cnt")


@query("image_path", IMAGES + "SELECT coreid, cnt, image_path FROM images")
def image_path(t):
    return t.images.select("coreid", "cnt", "image_path")


@query("sample_key", IMAGES + """
SELECT image_path, replace(lower(regexp_replace(image_path, '\\.[^./]*$', '')), '.', '_') AS sample_key FROM images""")
def sample_key(t):
    return t.images.select("image_path", names.sample_key().alias("sample_key"))


@query("subset_by_keys", IMAGES + """
SELECT image_path, acceptedTaxonKey FROM images WHERE acceptedTaxonKey IN (SELECT p_partkey % 900 FROM part WHERE p_size > 40)""")
def subset_by_keys(t):
    keys = t.part.filter("p_size > 40").select((F.col("p_partkey") % 900).alias("k"))
    return filters.subset_by_keys(t.images, "acceptedTaxonKey", keys).select("image_path", "acceptedTaxonKey")


@query("require_dataset_key", IMAGES + "SELECT image_path, datasetKey FROM images WHERE datasetKey IS NOT NULL")
def require_dataset_key(t):
    return filters.require_dataset_key(t.images).select("image_path", "datasetKey")


@query("ignore_dataset", IMAGES + """
SELECT image_path, datasetKey FROM images WHERE NOT coalesce(datasetKey IN ('ds3', 'ds5'), FALSE)""")
def ignore_dataset(t):
    return filters.ignore_dataset(t.images, "ds3,ds5").select("image_path", "datasetKey")


@query("remove_thumbnails", with_views("verified") + """
SELECT image_path, width, height FROM verified WHERE NOT coalesce(width < 64, FALSE) AND NOT coalesce(height < 64, FALSE)""")
def remove_thumbnails(t):
    return filters.remove_thumbnails(t.verified).select("image_path", "width", "height")


@query("remove_non_adults", CLEAN_INPUT + """
SELECT image_path, lifeStage, life_stage_prediction FROM rows_
WHERE coalesce(lifeStage IN ('Adult', 'Imago'), FALSE) OR coalesce(life_stage_prediction = 'Adult', FALSE)""")
def remove_non_adults(t):
    return filters.remove_non_adults(_rows(t)).select("image_path", "lifeStage", "life_stage_prediction")


@query("clean_funnel", RULES + """
SELECT CAST(CASE rule WHEN 'duplicate_url' THEN 1 WHEN 'dataset' THEN 2 WHEN 'thumbnail' THEN 3 WHEN 'non_adult' THEN 4 ELSE 5 END AS INT) AS step,
       rule, count(*) AS images FROM ruled GROUP BY rule""")
def clean_funnel(t):
    return filters.clean_funnel(_rows(t), ignored="ds3,ds5")[1]


@query("clean_dataset", RULES + "SELECT image_path, identifier, coreid, acceptedTaxonKey, width, height FROM ruled WHERE rule = 'kept'")
def clean_dataset(t):
    return filters.clean_funnel(_rows(t), ignored="ds3,ds5")[0].select(
        "image_path", "identifier", "coreid", "acceptedTaxonKey", "width", "height")


@query("flagship", RULES + """
SELECT acceptedTaxonKey, count(*) AS images, count(DISTINCT coreid) AS occurrences FROM ruled
WHERE rule = 'kept' AND acceptedTaxonKey IS NOT NULL GROUP BY acceptedTaxonKey""")
def flagship(t):
    return dataset.flagship(t)


@query("checklist_filter", with_views("checklist") + """
SELECT row_id, family, gbif_species FROM checklist WHERE rank = 'SPECIES' AND NOT coalesce(family IN ('PROMO', 'ECONOMY'), FALSE)""")
def checklist_filter(t):
    return filters.checklist_filter(t.checklist, families=("PROMO", "ECONOMY")).select("row_id", "family", "gbif_species")


@query("null_lifestage_filter", IMAGES + "SELECT image_path FROM images WHERE lifeStage IS NULL")
def null_lifestage_filter(t):
    return filters.null_lifestage_filter(t.images).select("image_path")


@query("verified_join", with_views("images", "verified") + """
SELECT v.image_path, v.width, v.height, i.identifier, i.acceptedTaxonKey FROM verified v JOIN images i ON v.image_path = i.image_path""")
def verified_join(t):
    t = t.frozen("identifier", "acceptedTaxonKey")
    return joins.verified_join(t.verified, t.images).select("image_path", "width", "height", "identifier", "acceptedTaxonKey")


@query("lifestage_join", CLEAN_INPUT + "SELECT image_path, lifeStage, life_stage_prediction FROM rows_")
def lifestage_join(t):
    return _rows(t).select("image_path", "lifeStage", "life_stage_prediction")


@query("resume_anti_join", with_views("images", "verified") + """
SELECT i.image_path, v.width, v.image_path IS NOT NULL AS done FROM images i LEFT JOIN verified v ON v.image_path = i.image_path""")
def resume_anti_join(t):
    t = t.frozen()
    todo, done = joins.resume_anti_join(t.images.select("image_path"), t.verified)
    return (
        done.select("image_path", "width", F.lit(True).alias("done"))
        .unionByName(todo.withColumn("done", F.lit(False)), allowMissingColumns=True)
    )


@query("missing_file_anti_join", with_views("images", "verified") + """
SELECT i.image_path, CASE WHEN v.image_path IS NOT NULL THEN 'present' WHEN i.l_suppkey % 3 = 0 THEN 'cached' ELSE 'fetch' END AS state
FROM images i LEFT JOIN verified v ON v.image_path = i.image_path""")
def missing_file_anti_join(t):
    t = t.frozen()
    cached = t.images.filter("l_suppkey % 3 = 0")
    return joins.missing_file_anti_join(t.images.select("image_path"), t.verified, cached)


@query("drop_all_duplicates", IMAGES + """
SELECT image_path, identifier FROM (SELECT *, count(*) OVER (PARTITION BY identifier) AS n FROM images) q WHERE n = 1""")
def drop_all_duplicates(t):
    return filters.drop_all_duplicates(t.images.select("image_path", "identifier"))


@query("first_per_occurrence", IMAGES + "SELECT coreid, image_path, identifier, ord FROM images WHERE cnt = 0")
def first_per_occurrence(t):
    return joins.first_per_occurrence(t.images.select("coreid", "image_path", "identifier", "ord"), order="ord")


@query("sql_join_count", with_views("images", "taxonomy") + """
SELECT x.family, count(*) AS n FROM images i JOIN taxonomy x ON i.acceptedTaxonKey = x.speciesKey GROUP BY x.family""")
def sql_join_count(t):
    return joins.sql_join_count(t.images, t.taxonomy, "acceptedTaxonKey", "speciesKey")


@query("file_time", IMAGES + "SELECT image_path, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS fetch_date FROM images")
def file_time(t):
    return t.images.select("image_path", names.file_time("l_shipdate").alias("fetch_date"))
