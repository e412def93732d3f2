"""Scan, sink, job and annotation queries. Files are written below the session's shared folder."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from fieldlens.catalog import query
from fieldlens.functions import names
from fieldlens.operators import annotations, checklists, joins, matching
from fieldlens.plans.fixtures import with_views
from fieldlens.schemas import VERIFICATION
from fieldlens.session import work_dir
from fieldlens.sources import documents, images, jobs, shards, tables
from fieldlens.sources.csv_ranges import csv_scan
from fieldlens.streaming.verify import incremental_verify

MEGA_ROWS = """,
 m_ AS (SELECT image, box_id AS pos, CASE WHEN jitter < 2 THEN 0e0 ELSE round(score, 1) END AS conf, x1 / 700 AS x, y1 / 500 AS y, (x2 - x1) / 700 AS width, (y2 - y1) / 500 AS height FROM boxes)"""
ITEMS = with_views("annotation_items", "annotation_tasks", "taxon_db") + """,
 items_ AS MATERIALIZED (SELECT * REPLACE (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS pos) FROM annotation_items WHERE NOT fixed OR rev),
 tax_ids_ AS (SELECT DISTINCT conv_id, item_id FROM items_ WHERE type = 'taxonomy'),
 labels_ AS MATERIALIZED (SELECT i.*, CASE WHEN type = 'taxonomy' THEN split_part(coalesce(path_b, path_a), '/', -1) ELSE label END AS name FROM items_ i
   WHERE type = 'taxonomy' OR (type = 'labels' AND label IS NOT NULL AND label <> 'Unclassified'
         AND (conv_id, item_id) NOT IN (SELECT (conv_id, item_id) FROM tax_ids_)))"""
CATEGORIES = """,
 cat_ AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS class_id FROM (SELECT DISTINCT name FROM labels_) q)"""


@query("dwca_scan", with_views("media", "occurrence") + """
SELECT m.coreid, m.identifier, row_number() OVER (PARTITION BY m.coreid ORDER BY m.ord) - 1 AS cnt, o.datasetKey, o.acceptedTaxonKey, o.lifeStage,
 round(o.decimalLatitude, 6) AS decimalLatitude, strftime(o.eventDate, '%Y-%m-%d') AS eventDate FROM media m JOIN occurrence o ON o.id = m.coreid""")
def dwca_scan(t):
    spark = t.spark
    base = work_dir(spark, "archive")
    tsv = {"sep": "\t", "header": True, "quote": "", "emptyValue": "", "nullValue": "", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
    rights = F.lit("CC-BY").alias("rights")
    # one sorted file per range, like an archive exported in key order
    t.media.select(rights, "coreid", "identifier", "ord").repartitionByRange("coreid", "ord").sortWithinPartitions("coreid", "ord").drop("ord").write.options(**tsv).csv(base + "/multimedia.txt")
    t.occurrence.select(rights, "*").write.options(**tsv).csv(base + "/occurrence.txt")
    media, occurrence = tables.dwca_scan(spark, base + "/multimedia.txt", base + "/occurrence.txt")
    rows = joins.occurrence_media_join(joins.cumcount(media), occurrence)
    return rows.select("coreid", "identifier", "cnt", "datasetKey", "acceptedTaxonKey", "lifeStage",
                       F.round("decimalLatitude", 6).alias("decimalLatitude"), F.date_format("eventDate", "yyyy-MM-dd").alias("eventDate"))


@query("csv_io", with_views("verified") + """
SELECT image_path, width, height, strftime(fetch_date, '%Y-%m-%d') AS fetch_date, file_size, corrupted FROM verified""")
def csv_io(t):
    path = work_dir(t.spark, "csv")
    tables.write_table(t.verified, path, "csv", partition_by=["corrupted"])
    return tables.read_table(t.spark, path, VERIFICATION, "csv").withColumn("fetch_date", F.date_format("fetch_date", "yyyy-MM-dd"))


@query("csv_line_breaks", "SELECT doc_id, text, lang, n_chars FROM documents WHERE text <> '' AND source IS NOT NULL")
def csv_line_breaks(t):
    """Long texts with line breaks, commas and quotes; ranges of a file begin anywhere in them."""
    path = work_dir(t.spark, "texts")
    tables.write_table(t.documents.filter("text <> '' AND source IS NOT NULL").select("doc_id", "text", "lang", "n_chars"), path, "csv")
    return csv_scan(t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint", range_bytes=1 << 20)


@query("json_map_io", """
SELECT concat('event ', CAST(event_id AS VARCHAR)) AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_map_io(t):
    path = work_dir(t.spark, "map")
    rows = documents.map_rows(t.events, "props", "bigint", keep=("event_id",)).filter("key = 'k'")
    named = rows.select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"), "value")
    documents.write_json_map(named, "name", "value", path)
    return documents.read_json_map(t.spark, path, "bigint")


@query("json_map_document", "SELECT DISTINCT concat('doc ', CAST(doc_id AS VARCHAR)) AS key, n_chars AS value FROM documents")
def json_map_document(t):
    """One large {key: value} object a partition, as a category map is exported."""
    path = work_dir(t.spark, "map-document")
    pairs = t.documents.select("doc_id", "n_chars").distinct().groupBy(F.spark_partition_id()).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), "n_chars"))).alias("m"))
    pairs.select(F.to_json("m", {"pretty": "true"}).alias("value")).write.option("lineSep", "\n").text(path)
    return documents.read_json_map(t.spark, path, "bigint", one_document=True)


@query("annotation_json_scan", with_views("annotation_items", "annotation_tasks") + """,
 n_ AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS task_id FROM annotation_tasks)
SELECT n.task_id, t.image, t.deployment, row_number() OVER (PARTITION BY t.conv_id ORDER BY i.pos) - 1 AS pos, CAST(i.item_id AS VARCHAR) AS item_id, i.type, i.x, i.label
 FROM annotation_tasks t JOIN annotation_items i ON i.conv_id = t.conv_id JOIN n_ n ON n.conv_id = t.conv_id""")
def annotation_json_scan(t):
    path = work_dir(t.spark, "tasks")
    documents.write_json_array(t.tasks.repartitionByRange("task_id").sortWithinPartitions("task_id").drop("task_id"), path)
    rows = documents.annotation_json_scan(t.spark, path, one_document=True)
    rows = rows.select("task_id", "data.*", F.posexplode(F.col("annotations")[0]["result"]).alias("pos", "i"))
    return rows.select("task_id", "image", "deployment", F.col("pos").cast("long").alias("pos"), F.col("i.id").alias("item_id"), "i.type", "i.value.x",
                       F.get("i.value.labels", F.lit(0)).alias("label"))


@query("prediction_json_scan", with_views("det_boxes") + """
SELECT CAST(image AS VARCHAR) AS image, CAST(row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) - 1 AS INTEGER) AS pos, CAST(x1 AS DOUBLE) AS x1,
 CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(1 AS BIGINT) AS label, score FROM det_boxes""")
def prediction_json_scan(t):
    path = work_dir(t.spark, "preds")
    documents.write_prediction_json(matching.nested_regroup(t.det_boxes.withColumn("label", F.lit(1))), path)
    return documents.prediction_json_scan(t.spark, path)


def _per_image(t, lists):
    """{image: lists} objects, one a line."""
    boxes = t.det_boxes.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2", "score"))).alias("b"))
    name = F.regexp_replace(F.to_json(F.array(F.col("image").cast("string"))), r"^\[|\]$", "")
    listed = F.concat_ws(", ", *[F.to_json(F.transform("b", f)) for f in lists])
    return boxes.select(F.concat(F.lit("{"), name, F.lit(": ["), listed, F.lit("]}")).alias("value"))


@query("classified_boxes_scan", with_views("det_boxes") + """
SELECT CAST(image AS VARCHAR) AS image, CAST(row_number() OVER (PARTITION BY image ORDER BY box_id) - 1 AS INTEGER) AS pos, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
 CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, CAST(1 AS BIGINT) AS label, CASE WHEN box_id % 3 = 0 THEN 'nonmoth' ELSE 'moth' END AS class,
 CASE WHEN box_id % 3 = 0 THEN 'nonmoth' ELSE concat('sp ', CAST(box_id % 7 AS VARCHAR)) END AS subclass, CAST(floor(score * 100) AS DOUBLE) AS confidence FROM det_boxes""")
def classified_boxes_scan(t):
    other = lambda b: b["box_id"] % 3 == 0
    path = work_dir(t.spark, "classified")
    _per_image(t, [
        lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]), lambda b: F.lit(1),
        lambda b: F.when(other(b), "nonmoth").otherwise("moth"),
        lambda b: F.when(other(b), "nonmoth").otherwise(F.concat(F.lit("sp "), (b["box_id"] % 7).cast("string"))), lambda b: F.floor(b["score"] * 100),
    ]).write.text(path)
    return documents.classified_boxes_scan(t.spark, path, one_document=False)


@query("detector_results_scan", with_views("boxes") + MEGA_ROWS + """
SELECT concat('im', CAST(image AS VARCHAR), '.jpg') AS image, CAST(row_number() OVER (PARTITION BY image ORDER BY pos) - 1 AS INTEGER) AS pos, '1' AS category,
 conf, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height FROM m_""")
def detector_results_scan(t):
    """One results document a partition, as the detector writes it."""
    path = work_dir(t.spark, "detector")
    box = F.array(*[F.round(c, 6) for c in (F.col("x1") / 700, F.col("y1") / 500, (F.col("x2") - F.col("x1")) / 700, (F.col("y2") - F.col("y1")) / 500)])
    conf = F.when(F.col("jitter") < 2, 0.0).otherwise(F.round("score", 1))
    one = F.struct("box_id", F.lit("1").alias("category"), conf.alias("conf"), box.alias("bbox"))
    images_ = t.boxes.groupBy("image").agg(F.sort_array(F.collect_list(one)).alias("d")).select(
        F.to_json(F.struct(F.concat(F.lit("im"), F.col("image").cast("string"), F.lit(".jpg")).alias("file"),
                           F.transform("d", lambda d: F.struct(d["category"].alias("category"), d["conf"].alias("conf"), d["bbox"].alias("bbox"))).alias("detections"))).alias("value"))
    whole = images_.groupBy(F.spark_partition_id()).agg(F.concat_ws(",\n  ", F.collect_list("value")).alias("v"))
    whole.select(F.concat(F.lit('{"info": {"detector": "v5"},\n "detection_categories": {"1": "animal"},\n "images": [\n  '), "v", F.lit("\n]}")).alias("value")).write.text(path)
    return documents.detector_results_scan(t.spark, path)


@query("crop_records_scan", with_views("crop_labels") + """
SELECT concat('trap', CAST(crop_id % 97 AS VARCHAR)) AS image, CAST(row_number() OVER (PARTITION BY crop_id % 97 ORDER BY crop_id) - 1 AS INTEGER) AS pos, label AS gt, taxon_rank AS gt_rank,
 CASE WHEN crop_id % 5 = 0 THEN 'nonmoth' ELSE 'moth' END AS binary, CAST(crop_id % 10 AS DOUBLE) / 10 AS xc,
 CASE WHEN crop_id % 5 <> 0 THEN concat('other ', CAST(crop_id % 7 AS VARCHAR)) END AS second, CASE WHEN crop_id % 5 <> 0 THEN 0.25e0 END AS second_conf FROM crop_labels""")
def crop_records_scan(t):
    """One array of records an image, written as its file."""
    root = work_dir(t.spark, "crops")
    ranked = F.when(F.col("crop_id") % 5 == 0, '"Not required"').otherwise(F.concat(
        F.lit('[["'), "label", F.lit('", 0.75], ["other '), (F.col("crop_id") % 7).cast("string"), F.lit('", 0.25]]')))
    record = F.concat(F.lit('  {"ground_truth": ["'), "label", F.lit('", "'), "taxon_rank", F.lit('"],\n   "binary_classification": "'),
                      F.when(F.col("crop_id") % 5 == 0, "nonmoth").otherwise("moth"), F.lit('",\n   "moth_classification": '), ranked,
                      F.lit(',\n   "bbox_coordinates": ["'), (F.col("crop_id") % 10 / 10).cast("string"), F.lit('", "0.5", "0.1", "0.1"]}'))
    per_image = t.crop_labels.groupBy(F.concat(F.lit("trap"), (F.col("crop_id") % 97).cast("string")).alias("image")).agg(
        F.sort_array(F.collect_list(F.struct("crop_id", record.alias("r")))).alias("r"))
    documents.text_files_sink(per_image.select("image", F.concat(F.lit("[\n"), F.array_join("r.r", ",\n"), F.lit("\n]")).alias("content")), root, ".json")
    rows = documents.crop_records_scan(t.spark, root)
    second = F.get("predictions", F.lit(1))
    return rows.select("image", "pos", "gt", "gt_rank", "binary", "xc", second["name"].alias("second"), second["conf"].alias("second_conf"))


@query("resolve_review", ITEMS + "SELECT conv_id AS task_id, CAST(item_id AS VARCHAR) AS item_id, pos, type FROM items_")
def resolve_review(t):
    rows = annotations.resolve_review(t.tasks).select("task_id", F.explode("items").alias("i"))
    return rows.select("task_id", F.col("i.id").alias("item_id"), "i.pos", "i.type")


@query("deepest_taxon_label", ITEMS + "SELECT conv_id AS task_id, CAST(item_id AS VARCHAR) AS item_id, pos, type, name AS label FROM labels_")
def deepest_taxon_label(t):
    return annotations.deepest_taxon_label(annotations.resolve_review(t.tasks)).select("task_id", "item_id", "pos", "type", "label")


@query("region_of_deployment", with_views("annotation_tasks") + """
SELECT conv_id AS task_id, deployment, CASE WHEN contains(deployment, 'Panama') THEN 'CentralAmerica' WHEN contains(deployment, 'UK') OR contains(deployment, 'Denmark') THEN 'WesternEurope'
 WHEN contains(deployment, 'Quebec') OR contains(deployment, 'Vermont') THEN 'NorthEasternAmerica' ELSE 'rejected' END AS region FROM annotation_tasks""")
def region_of_deployment(t):
    rows = t.annotation_tasks.select(F.col("conv_id").alias("task_id"), "deployment", names.region_of_deployment("deployment").alias("region"))
    # unmatched rows form the reject table
    return rows.filter("region IS NOT NULL").unionByName(rows.filter("region IS NULL").withColumn("region", F.lit("rejected")))


def _labels(t):
    return annotations.deepest_taxon_label(annotations.resolve_review(t.tasks))


LINES = ITEMS + CATEGORIES + """,
 lines_ AS (SELECT t.conv_id, split_part(split_part(t.image, '/', -1), '.', 1) AS image, l.type, l.pos, concat_ws(' ', c.class_id,
   CASE WHEN (x + width / 2) / 100 > 1 THEN '1' ELSE CAST(round(least((x + width / 2) / 100, 1e0), 5) AS VARCHAR) END,
   CASE WHEN (y + height / 2) / 100 > 1 THEN '1' ELSE CAST(round(least((y + height / 2) / 100, 1e0), 5) AS VARCHAR) END,
   CAST(round(width / 100, 5) AS VARCHAR), CAST(round(height / 100, 5) AS VARCHAR)) AS line
   FROM labels_ l JOIN cat_ c ON c.name = l.name JOIN annotation_tasks t ON t.conv_id = l.conv_id),
 last_ AS (SELECT split_part(split_part(image, '/', -1), '.', 1) AS image, max(conv_id) AS conv_id FROM annotation_tasks GROUP BY 1)"""


def _label_files(t):
    """Label files of all photographs, written; their folder."""
    root = work_dir(t.spark, "yolo")
    labels = _labels(t).withColumn("image", names.file_stem("image"))
    lines = annotations.yolo_lines(labels, checklists.category_map(labels, "label"))
    documents.yolo_label_sink(annotations.yolo_files(lines, t.tasks), root)
    return root


@query("yolo_label_sink", LINES + """
SELECT f.image, coalesce(string_agg(l.line || chr(10), '' ORDER BY l.type <> 'taxonomy', l.pos), '') AS content FROM last_ f LEFT JOIN lines_ l ON l.conv_id = f.conv_id GROUP BY f.image""")
def yolo_label_sink(t):
    photographs = t.tasks.select(names.file_stem("data.image").alias("image")).distinct()
    return documents.text_files_scan(photographs, _label_files(t), ".txt")


@query("yolo_label_scan", LINES + """
SELECT l.image, CAST(split_part(line, ' ', 1) AS INTEGER) AS class_id, CAST(split_part(line, ' ', 2) AS DOUBLE) AS xc, CAST(split_part(line, ' ', 3) AS DOUBLE) AS yc,
 CAST(split_part(line, ' ', 4) AS DOUBLE) AS w, CAST(split_part(line, ' ', 5) AS DOUBLE) AS h FROM lines_ l JOIN last_ USING (image, conv_id)""")
def yolo_label_scan(t):
    return documents.yolo_label_scan(t.spark, _label_files(t))


@query("region_sidecar", with_views("annotation_tasks") + """,
 known_ AS (SELECT conv_id, split_part(split_part(image, '/', -1), '.', 1) AS image, CASE WHEN contains(deployment, 'Panama') THEN 'CentralAmerica' WHEN contains(deployment, 'UK') OR contains(deployment, 'Denmark')
   THEN 'WesternEurope' WHEN contains(deployment, 'Quebec') OR contains(deployment, 'Vermont') THEN 'NorthEasternAmerica' END AS region FROM annotation_tasks),
 last_ AS (SELECT image, arg_max(region, conv_id) AS region FROM known_ WHERE region IS NOT NULL GROUP BY image)
SELECT image, region, CAST(1 + CAST(substr(image, 2) AS BIGINT) % 13 AS INTEGER) AS width, CAST(1 + CAST(substr(image, 2) AS BIGINT) % 7 AS INTEGER) AS height FROM last_""")
def region_sidecar(t):
    """Sizes are read from the photographs; the sidecars are written and read back."""
    base = work_dir(t.spark, "sidecars")
    known = t.tasks.filter(names.region_of_deployment("data.deployment").isNotNull())
    stems = known.select(names.file_stem("data.image").alias("image")).distinct().withColumn("k", F.substring("image", 2, 20).cast("long"))
    photos = stems.select(F.concat("image", F.lit(".jpg")).alias("image_path"), F.col("k").alias("s_suppkey"))
    jobs.write_files(photos.mapInPandas(_drawn, "s_suppkey bigint, image_path string, content binary"), base + "/photos", "image_path", "content")
    sizes = images.image_info(photos.select("image_path"), base + "/photos").withColumn("image", names.file_stem("image_path"))
    documents.text_files_sink(annotations.region_sidecars(known, sizes), base + "/metadata", ".json")
    read = documents.text_files_scan(stems, base + "/metadata", ".json")
    fields = F.from_json("content", "region string, image_width int, image_height int", {"mode": "FAILFAST"})
    return read.select("image", fields.alias("f")).select("image", "f.region", F.col("f.image_width").alias("width"), F.col("f.image_height").alias("height"))


@query("annotation_statistics", ITEMS + """,
 n_ AS (SELECT sum(CASE WHEN type = 'rectangle' THEN 1 ELSE 0 END) AS boxes, sum(CASE WHEN type = 'labels' THEN 1 ELSE 0 END) AS labels,
   sum(CASE WHEN type = 'labels' AND label = 'Non-Moth' THEN 1 ELSE 0 END) AS nonmoths, sum(CASE WHEN type = 'labels' AND label = 'Moth' THEN 1 ELSE 0 END) AS cm,
   sum(CASE WHEN type = 'labels' AND label = 'Unidentifiable' THEN 1 ELSE 0 END) AS unidentify, sum(CASE WHEN type = 'labels' AND label IS NULL THEN 1 ELSE 0 END) AS empty_,
   sum(CASE WHEN type = 'taxonomy' AND path_b IS NOT NULL THEN 1 ELSE 0 END) AS mul_label,
   sum(CASE WHEN type = 'taxonomy' AND (conv_id, item_id) NOT IN (SELECT (conv_id, item_id) FROM items_ WHERE type = 'labels') THEN 1 ELSE 0 END) AS dir_ FROM items_),
 taxa_ AS (SELECT unnest(string_split(coalesce(path_b, path_a), '/')) AS name FROM items_ WHERE type = 'taxonomy'
   UNION ALL SELECT unnest(string_split(path_a, '/')) FROM items_ WHERE type = 'taxonomy' AND path_b IS NOT NULL AND NOT starts_with(path_b, path_a)),
 r_ AS (SELECT lower(d.rank) AS rank, count(*) AS n, count(DISTINCT t.name) AS k FROM taxa_ t JOIN taxon_db d ON d.name = t.name GROUP BY 1),
 p_ AS (SELECT *, split_part(deployment, ' ', 1) AS place, row_number() OVER (PARTITION BY image ORDER BY conv_id) AS copy FROM annotation_tasks)
SELECT 'boxes' AS counter, CAST(boxes AS BIGINT) AS value FROM n_ UNION ALL SELECT 'labels', CAST(labels AS BIGINT) FROM n_ UNION ALL SELECT 'nonmoths', CAST(nonmoths AS BIGINT) FROM n_
UNION ALL SELECT 'moths', CAST(cm + dir_ AS BIGINT) FROM n_ UNION ALL SELECT 'unidentify', CAST(unidentify AS BIGINT) FROM n_
UNION ALL SELECT 'unclassify', CAST(empty_ + boxes - labels - dir_ AS BIGINT) FROM n_ UNION ALL SELECT 'mul_label', CAST(mul_label AS BIGINT) FROM n_
UNION ALL SELECT 'moths_dir_label', CAST(dir_ AS BIGINT) FROM n_ UNION ALL SELECT concat('labels_', rank), n FROM r_ UNION ALL SELECT concat('taxa_', rank), k FROM r_
UNION ALL SELECT concat('tasks_', lower(place)), count(CASE WHEN place <> 'Denmark' OR copy = 1 THEN 1 END) FROM p_ WHERE place <> 'Nowhere' GROUP BY place""")
def annotation_statistics(t):
    return annotations.annotation_statistics(annotations.resolve_review(t.tasks), t.taxon_db)


@query("metadata_projection", with_views("images") + """
SELECT image_path, CAST(to_json(struct_pack(coreid := coreid, acceptedTaxonKey := acceptedTaxonKey, lifeStage := lifeStage)) AS VARCHAR) AS json,
 CAST(to_json(struct_pack(datasetKey := coalesce(datasetKey, 'NA'), lifeStage := coalesce(lifeStage, 'NA'))) AS VARCHAR) AS json_na FROM images""")
def metadata_projection(t):
    return t.images.select("image_path", documents.metadata_projection("coreid", "acceptedTaxonKey", "lifeStage").alias("json"),
                           documents.metadata_projection("datasetKey", "lifeStage", missing="NA").alias("json_na"))


def bmp_bytes(width: int, height: int) -> bytes:
    """A blank 24-bit bitmap."""
    row = (width * 3 + 3) // 4 * 4
    header = b"BM" + struct.pack("<IHHI", 54 + row * height, 0, 0, 54)
    return header + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, row * height, 0, 0, 0, 0) + bytes(row * height)


def _drawn(batches):
    """Small photographs, their sizes told by a key."""
    for b in batches:
        yield b[["s_suppkey", "image_path"]].assign(content=[bmp_bytes(1 + k % 13, 1 + k % 7) for k in b["s_suppkey"]])


def _photos(t):
    """One small photograph per supplier; 7 in 10 rows are good, the others broken, missing or empty."""

    def draw(batches):
        for b in _drawn(batches):
            b["content"] = [b"not an image" if k % 10 == 7 else b"" if k % 10 == 9 else c for k, c in zip(b["s_suppkey"], b["content"], strict=True)]
            yield b

    keyed = t.supplier.select("s_suppkey", F.concat(F.lit("ds"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("image_path"))
    return keyed, keyed.mapInPandas(draw, "s_suppkey bigint, image_path string, content binary")


PHOTOS = """
WITH p_ AS (SELECT s_suppkey AS k, concat('ds', CAST(s_nationkey AS VARCHAR), '/', CAST(s_suppkey AS VARCHAR), '.jpg') AS image_path FROM supplier),
 i_ AS (SELECT *, CASE WHEN k % 10 < 7 THEN CAST(1 + k % 13 AS INTEGER) END AS width, CASE WHEN k % 10 < 7 THEN CAST(1 + k % 7 AS INTEGER) END AS height,
        CASE WHEN k % 10 < 7 THEN 54 + (((1 + k % 13) * 3 + 3) // 4 * 4) * (1 + k % 7) END AS file_size, k % 10 IN (7, 9) AS corrupted FROM p_)"""


@query("image_info", PHOTOS + "SELECT image_path, width, height, file_size, corrupted, width IS NOT NULL AS dated FROM i_")
def image_info(t):
    root = work_dir(t.spark, "photos")
    keyed, photos = _photos(t)
    jobs.write_files(photos.filter("s_suppkey % 10 <> 8"), root, "image_path", "content")
    info = images.image_info(keyed, root)
    return info.select("image_path", "width", "height", "file_size", "corrupted", F.col("fetch_date").isNotNull().alias("dated"))


@query("incremental_verify", PHOTOS + "SELECT image_path, width, height, file_size, corrupted FROM i_ WHERE k % 10 <= 7")
def incremental_verify_query(t):
    base = work_dir(t.spark, "incremental")
    _, photos = _photos(t)
    root, results, checkpoint = base + "/photos", base + "/results", base + "/state"
    jobs.write_files(photos.filter("s_suppkey % 2 = 0 AND s_suppkey % 10 <= 7"), root, "image_path", "content")
    incremental_verify(t.spark, root, results, checkpoint)
    jobs.write_files(photos.filter("s_suppkey % 2 = 1 AND s_suppkey % 10 <= 7"), root, "image_path", "content")
    done = incremental_verify(t.spark, root, results, checkpoint)
    return done.select("image_path", "width", "height", "file_size", "corrupted")


@query("path_taxonomy_scan", with_views("taxonomy") + """,
 f_ AS (SELECT x.*, concat(CAST(s_suppkey AS VARCHAR), '.jpg') AS filename FROM supplier s JOIN taxonomy x ON x.speciesKey = s.s_suppkey % 200 WHERE s_suppkey % 10 NOT IN (8, 9))
SELECT 'file' AS level, filename AS name, family, genus, species, CAST(1 AS BIGINT) AS files FROM f_
UNION ALL SELECT 'family', family, NULL, NULL, NULL, count(*) FROM f_ GROUP BY family UNION ALL SELECT 'genus', genus, NULL, NULL, NULL, count(*) FROM f_ GROUP BY genus
UNION ALL SELECT 'species', species, NULL, NULL, NULL, count(*) FROM f_ GROUP BY species""")
def path_taxonomy_scan(t):
    root = work_dir(t.spark, "tree")
    _, photos = _photos(t)
    tree = photos.filter("s_suppkey % 10 NOT IN (8, 9)").withColumn("speciesKey", F.col("s_suppkey") % 200).join(t.taxonomy, "speciesKey").select(
        F.concat_ws("/", "family", "genus", "species", F.concat(F.col("s_suppkey").cast("string"), F.lit(".jpg"))).alias("path"), "content")
    jobs.write_files(tree, root, "path", "content")
    taxa = images.path_taxonomy_scan(t.spark, root)
    rows = taxa.select(F.lit("file").alias("level"), F.col("filename").alias("name"), "family", "genus", "species", F.lit(1).cast("long").alias("files"))
    return rows.unionByName(images.tree_counts(taxa), allowMissingColumns=True)


SHARDED = """
WITH RECURSIVE d_ AS (SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS sample_key, octet_length(encode(text)) AS size, lang, source, CAST(to_json(struct_pack(lang := lang, source := source)) AS VARCHAR) AS json FROM documents),
 z_ AS (SELECT *, size + octet_length(encode(lang)) + octet_length(encode(json)) AS whole FROM d_),
 r_ AS MATERIALIZED (SELECT *, sum(whole) OVER (ORDER BY md5(concat_ws('|', '42', sample_key)), sample_key ROWS UNBOUNDED PRECEDING) - whole AS before_ FROM z_),
 b_ AS (SELECT CAST(0 AS BIGINT) AS shard, CAST(0 AS HUGEINT) AS start UNION ALL
        SELECT shard + 1, (SELECT min(before_) FROM r_ WHERE before_ >= start + 500000) FROM b_ WHERE EXISTS (SELECT 1 FROM r_ WHERE before_ >= start + 500000)),
 s_ AS (SELECT r_.*, (SELECT max(shard) FROM b_ WHERE start <= before_) AS shard FROM r_)"""


def _samples(t):
    return t.documents.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("sample_key"), F.encode("text", "UTF-8").alias("jpg"),
        F.octet_length("text").alias("size"), F.col("lang").alias("cls"), documents.metadata_projection("lang", "source").alias("json"))


@query("webdataset_sink", SHARDED + "SELECT shard, count(*) AS samples, CAST(sum(size) AS BIGINT) AS bytes FROM s_ GROUP BY shard")
def webdataset_sink(t):
    out = work_dir(t.spark, "shards")
    manifest = shards.webdataset_sink(_samples(t), out, "size", payload="jpg", metadata="json", max_shard_size=500_000)
    return manifest.select("shard", "samples", "bytes")


@query("webdataset_scan", SHARDED + """
SELECT sample_key AS key, shard, lang AS cls, size AS bytes, json FROM s_""")
def webdataset_scan(t):
    out = work_dir(t.spark, "shards")
    shards.webdataset_sink(_samples(t), out, "size", payload="jpg", metadata="json", max_shard_size=500_000)
    rows = shards.webdataset_scan(t.spark, out + "/*.tar")
    return rows.select("key", F.regexp_extract("path", r"shard-(\d+)\.tar", 1).cast("long").alias("shard"), "cls", F.octet_length("jpg").cast("long").alias("bytes"), "json")


@query("fetch_job", PHOTOS + """
SELECT image_path, CASE WHEN k % 4 = 2 THEN 'present' WHEN k % 4 = 1 THEN 'cached' WHEN k % 10 = 8 THEN 'error: URLError' ELSE 'fetched' END AS status FROM p_""")
def fetch_job(t):
    base = work_dir(t.spark, "fetch")
    keyed, photos = _photos(t)
    jobs.write_files(photos.filter("s_suppkey % 10 <> 8"), base + "/origin", "image_path", "content")
    jobs.write_files(photos.filter("s_suppkey % 4 = 1"), base + "/cache", "image_path", "content")
    jobs.write_files(photos.filter("s_suppkey % 4 = 2"), base + "/dataset", "image_path", "content")
    url = F.concat(F.lit(base if "://" in base else "file://" + base), F.lit("/origin/"), F.col("image_path"))
    return jobs.fetch_job(keyed.withColumn("identifier", url), base + "/dataset", base + "/cache")


@query("copy_job", PHOTOS + """
SELECT image_path AS source, concat(CAST(k % 5 AS VARCHAR), '/', split_part(image_path, '/', -1)) AS target,
 CASE WHEN k % 10 = 8 THEN 'missing' WHEN k % 4 = 1 THEN 'present' ELSE 'copied' END AS status FROM p_""")
def copy_job(t):
    """Photographs laid out by class; a part is there from an earlier run."""
    base = work_dir(t.spark, "layout")
    keyed, photos = _photos(t)
    target = F.concat((F.col("s_suppkey") % 5).cast("string"), F.lit("/"), F.substring_index("image_path", "/", -1))
    jobs.write_files(photos.filter("s_suppkey % 10 <> 8"), base + "/from", "image_path", "content")
    plan = keyed.select("s_suppkey", F.col("image_path").alias("source"), target.alias("target"))
    jobs.copy_job(plan.filter("s_suppkey % 4 = 1"), base + "/from", base + "/to")
    return jobs.copy_job(plan, base + "/from", base + "/to")


@query("delete_job", PHOTOS + "SELECT image_path AS filename, k % 10 <> 8 AS deleted FROM p_ WHERE k % 10 >= 7")
def delete_job(t):
    root = work_dir(t.spark, "delete")
    keyed, photos = _photos(t)
    jobs.write_files(photos.filter("s_suppkey % 10 <> 8"), root, "image_path", "content")
    return jobs.delete_job(keyed.filter("s_suppkey % 10 >= 7").select(F.col("image_path").alias("filename")), root)
