"""Archive, verification and lookup joins.

No join carries a broadcast hint: adaptive execution measures each side and broadcasts only what is
below ``spark.sql.autoBroadcastJoinThreshold``; larger sides shuffle and skewed partitions are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.operators.ordering import ranked


def occurrence_media_join(media: DataFrame, occurrence: DataFrame) -> DataFrame:
    return media.join(occurrence, media["coreid"] == occurrence["id"], "inner")


# a key with more rows than this is ranked in pieces; everything else is one ordinary window group
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(key)


def hot_values(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """The same keys as a list, at most one for every ``hot_rows`` rows. They are known before a plan is made, so without such
    keys nothing is shuffled for them."""
    return [r[0] for r in hot_keys(df.select(key).dropna(), key, hot_rows).collect()]


def _positions(key: str, order: Sequence[Column]) -> Column:
    return (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long")


def _scan_order(order: Sequence[Column] | None, bucket: Column | None) -> tuple[Sequence[Column], Column]:
    """Defaults to the scan's ``row_order`` (file, block, line), bucketed by file block."""
    if bucket is None:
        bucket = F.struct(F.col("row_order.file"), F.col("row_order.block"))
    return order or [F.col("row_order")], bucket


def _piecewise(df: DataFrame, key: str, order: Sequence[Column], bucket: Column) -> DataFrame:
    return ranked(df, [key], order, bucket, "_r").withColumn("cnt", F.col("_r") - 1).drop("_r")


def cumcount(
    media: DataFrame, key: str = "coreid", order: Sequence[Column] | None = None, bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position of each image within its occurrence, in file order."""
    order, bucket = _scan_order(order, bucket)
    hot = hot_values(media, key, hot_rows)
    keyed = media.dropna(subset=[key])
    if not hot:
        return keyed.withColumn("cnt", _positions(key, order))
    rest = keyed.filter(~F.col(key).isin(hot)).withColumn("cnt", _positions(key, order))
    return rest.unionByName(_piecewise(keyed.filter(F.col(key).isin(hot)), key, order, bucket))


def indexed_images(
    media: DataFrame, occurrence: DataFrame, order: Sequence[Column] | None = None, bucket: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Media joined to occurrences with ``cnt``, the position within the occurrence.

    The join and the window share one shuffle on the occurrence id. Occurrences with very many images take
    the other branch: their few occurrence rows meet the images without a shuffle and positions are made in
    pieces. They are counted first; without any, there is no such branch.
    """
    order, bucket = _scan_order(order, bucket)
    hot = hot_values(media, "coreid", hot_rows)
    if not hot:
        return occurrence_media_join(media, occurrence).withColumn("cnt", _positions("coreid", order))
    rest = occurrence_media_join(media.filter(~F.col("coreid").isin(hot)), occurrence)
    rest = rest.withColumn("cnt", _positions("coreid", order))
    crowded = _piecewise(media.filter(F.col("coreid").isin(hot)), "coreid", order, bucket)
    owners = occurrence.filter(F.col("id").isin(hot))
    return rest.unionByName(occurrence_media_join(crowded, owners))


def first_per_occurrence(df: DataFrame, order: str = "row_order", key: str = "coreid") -> DataFrame:
    """First row of each occurrence in row order, which tells the rows of an occurrence apart. Every map task cuts its rows
    to the first of an occurrence; rows that lie together by occurrence already are not shuffled."""
    place = F.rank().over(Window.partitionBy(key).orderBy(F.col(order)))
    return df.filter(F.col(order).isNotNull()).withColumn("_first", place).filter("_first = 1").drop("_first")


def verified_join(verified: DataFrame, metadata: DataFrame) -> DataFrame:
    return verified.select("image_path", "width", "height", "fetch_date").join(metadata, "image_path", "inner")


def lifestage_join(df: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Left join of predictions, one per image (the last in name order when a file lists an image twice)."""
    if predictions is None:
        return df.withColumn("life_stage_prediction", F.lit(None).cast("string"))
    single = predictions.groupBy("image_path").agg(F.max("life_stage_prediction").alias("life_stage_prediction"))
    return df.join(single, "image_path", "left")


def resume_anti_join(planned: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows still to verify, and the rows already verified with their old results."""
    todo = planned.join(verified.select("image_path"), "image_path", "left_anti")
    done = planned.join(verified, "image_path", "inner")
    return todo, done


def missing_file_anti_join(plan: DataFrame, on_disk: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """The plan with ``state`` = present, cached or fetch, from the two listings."""
    disk = on_disk.select("image_path").distinct().withColumn("_disk", F.lit(True))
    out = plan.join(disk, "image_path", "left")
    if cached is None:
        out = out.withColumn("_cache", F.lit(None).cast("boolean"))
    else:
        out = out.join(cached.select("image_path").distinct().withColumn("_cache", F.lit(True)), "image_path", "left")
    state = F.when(F.col("_disk"), "present").when(F.col("_cache"), "cached").otherwise("fetch")
    return out.withColumn("state", state).drop("_disk", "_cache")


def key_lookup_join(
    labels: DataFrame, checklist: DataFrame, key_map: DataFrame, order: str = "row_id", label: str = "label"
) -> DataFrame:
    """Synonym and keys of a species name: the searched name first, the accepted name as fallback."""
    by_search = checklist.groupBy(F.col("search_species").alias(label)).agg(
        F.min_by("gbif_species", order).alias("_syn"), F.min_by("accepted_taxon_key", order).alias("_k1")
    )
    by_name = checklist.groupBy(F.col("gbif_species").alias(label)).agg(
        F.min_by("accepted_taxon_key", order).alias("_k2")
    )
    keys = key_map.groupBy(F.col("species").alias(label)).agg(F.min("speciesKey").alias("speciesKey"))
    out = labels.join(by_search, label, "left").join(by_name, label, "left").join(keys, label, "left")
    return out.select(
        *labels.columns,
        F.when(F.col("_syn") != F.col(label), F.col("_syn")).alias("synonym"),
        "speciesKey",
        F.coalesce("_k1", "_k2").alias("acceptedTaxonKey"),
    )


def rank_lookup_join(labels: DataFrame, taxa: DataFrame, name: str = "name") -> DataFrame:
    ranks = taxa.groupBy(name).agg(F.min("rank").alias("rank"))
    return labels.join(ranks, name, "left").withColumn("rank", F.coalesce("rank", F.lit("NA")))


def higher_taxon_join(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Genus and family of a label: species give both, a genus its family, other ranks the family.

    ``taxonomy`` has (name, genus, family) with one row per name. Family labels stand for themselves.
    """
    out = labels.join(taxonomy.select(F.col("name").alias("label"), "genus", "family"), "label", "left")
    rank = F.col("taxon_rank")
    genus = F.when(rank == "SPECIES", F.col("genus")).when(rank == "GENUS", F.col("label"))
    family = F.when(rank == "FAMILY", F.col("label")).otherwise(F.col("family"))
    return out.select(*labels.columns, genus.alias("genus"), family.alias("family"))


def taxon_names(taxonomy: DataFrame) -> DataFrame:
    """(name, genus, family) rows for species, genus and family names of a species table."""
    rows = F.explode(
        F.array(
            F.struct(F.col("species").alias("name"), F.col("genus").alias("genus"), F.col("family").alias("family")),
            F.struct(F.col("genus").alias("name"), F.lit(None).cast("string").alias("genus"), F.col("family").alias("family")),
            F.struct(F.col("family").alias("name"), F.lit(None).cast("string").alias("genus"), F.col("family").alias("family")),
        )
    )
    return (
        taxonomy.select(rows.alias("t")).select("t.*").groupBy("name")
        .agg(F.min("genus").alias("genus"), F.min("family").alias("family"))
    )


def category_id_join(df: DataFrame, category_map: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Class ids by label text, and the labels without one. Class 0 is a class like any other."""
    ids = category_map.select(F.col("category").alias("_cat"), "class_id")
    joined = df.join(ids, F.col(label).cast("string") == F.col("_cat"), "left").drop("_cat")
    matched = joined.filter(F.col("class_id").isNotNull())
    unmatched = joined.filter(F.col("class_id").isNull()).groupBy(label).agg(F.count("*").alias("rows"))
    return matched, unmatched


def missing_species(labels: DataFrame, known: DataFrame, key: str = "acceptedTaxonKey", known_key: str = "speciesKey") -> DataFrame:
    """Distinct usable keys (not null, 0 or -1) that the taxonomy does not hold."""
    used = labels.filter(F.col(key).isNotNull() & ~F.col(key).isin(-1, 0)).select(key).distinct()
    return used.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def exclusion_filter(
    labels: DataFrame, excluded: DataFrame, region: str, ranks: Sequence[str] | None = None, key: str = "acceptedTaxonKey"
) -> DataFrame:
    """Labels of a region with a usable key outside the exclusion list; a missing key is kept.

    Without ``ranks`` every rank but ORDER passes.
    """
    rank = F.col("taxon_rank").isin(list(ranks)) if ranks else F.col("taxon_rank") != "ORDER"
    usable = F.coalesce(F.col(key) != -1, F.lit(True))
    kept = labels.filter(rank & (F.col("region") == region) & usable)
    return kept.join(excluded.select(F.col(excluded.columns[0]).alias(key)).distinct(), key, "left_anti")


def seen_unseen_split(test: DataFrame, train: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    seen = train.select(key).distinct()
    return test.join(seen, key, "left_semi"), test.join(seen, key, "left_anti")


def regional_mask_list(
    model_classes: DataFrame, taxonomy: DataFrame, regional: DataFrame, flag: str | None = None
) -> DataFrame:
    """Regional species that the model knows, optionally only those flagged 1.0."""
    names = model_classes.join(taxonomy, "speciesKey").select("species").distinct()
    out = regional.join(names, "species", "left_semi")
    return out.filter(F.col(flag) == 1.0) if flag else out


def checklist_accuracy_join(
    checklist: DataFrame, train_counts: DataFrame, test_counts: DataFrame, test_acc: DataFrame, trap_acc: DataFrame
) -> DataFrame:
    """Accepted, trained taxa with image counts and accuracies, 0 where nothing was measured."""
    key = "acceptedTaxonKey"
    accepted = checklist.filter(F.col("taxonomicStatus") == "ACCEPTED")
    acc = test_acc.select(key, F.round(F.col("correct") / F.col("total") * 100, 2).alias("gbif_test_top1_acc"))
    trap = trap_acc.select(
        "species",
        F.col("total").alias("traps_test_imgs"),
        F.round(F.col("top1") / F.col("total") * 100, 2).alias("traps_test_top1_acc"),
        F.round(F.col("top5") / F.col("total") * 100, 2).alias("traps_test_top5_acc"),
    )
    out = (
        accepted.join(train_counts.select(key, F.col("n").alias("gbif_train_imgs")), key, "inner")
        .join(test_counts.select(key, F.col("n").alias("gbif_test_imgs")), key, "left")
        .join(acc, key, "left")
        .join(trap, "species", "left")
    )
    measures = ["gbif_train_imgs", "gbif_test_imgs", "gbif_test_top1_acc", "traps_test_imgs",
                "traps_test_top1_acc", "traps_test_top5_acc"]
    return out.fillna(0, subset=measures)


def column_zip(left: DataFrame, right: DataFrame, left_pos: str, right_pos: str) -> DataFrame:
    """Columns of two equally long tables side by side, matched on explicit positions.

    A position present on one side only fails the job: the tables were not equally long.
    """
    l, r = left.withColumnRenamed(left_pos, "pos"), right.withColumnRenamed(right_pos, "_rpos")
    joined = l.join(r, F.col("pos") == F.col("_rpos"), "full_outer")
    uneven = F.col("pos").isNull() | F.col("_rpos").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("tables differ in length")).cast("long")).otherwise(F.col("pos"))
    return joined.withColumn("pos", checked).drop("_rpos")


def model_compare_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two models' labels per file with the truth parsed from the name, species files only counted correct."""
    from fieldlens.functions.names import true_label, true_rank

    joined = a.select("filename", F.col("label").alias("label_a")).join(
        b.select("filename", F.col("label").alias("label_b")), "filename", "left"
    )
    species = true_rank("filename") == "species"
    correct = {s: F.coalesce(species & (true_label("filename") == F.col(f"label_{s}")), F.lit(False)) for s in "ab"}
    return joined.select(
        "*",
        true_label("filename").alias("true_label"),
        true_rank("filename").alias("true_label_rank"),
        correct["a"].alias("correct_a"),
        correct["b"].alias("correct_b"),
    )


def model_compare_summary(compared: DataFrame) -> DataFrame:
    n = F.count_if(F.col("true_label_rank") == "species")
    return compared.agg(
        n.alias("species_files"),
        F.count_if("correct_a").alias("correct_a"),
        F.count_if("correct_b").alias("correct_b"),
        F.try_divide(F.count_if("correct_a"), n).alias("accuracy_a"),
        F.try_divide(F.count_if("correct_b"), n).alias("accuracy_b"),
    )


def sql_join_count(images: DataFrame, taxonomy: DataFrame, image_key: str, taxon_key: str) -> DataFrame:
    """Images per family, most first. Works the same over a table read with ``spark.read.jdbc``.

    Counted per key before the join, so a hot key crosses the shuffle as one row.
    """
    per_key = images.groupBy(F.col(image_key).alias(taxon_key)).agg(F.count("*").alias("_n"))
    return (
        per_key.join(taxonomy, taxon_key).groupBy("family").agg(F.sum("_n").alias("n"))
        .orderBy(F.desc("n"), "family")
    )
