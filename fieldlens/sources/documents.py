"""JSON maps and lists, annotation tasks, nested predictions and YOLO label files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.names import decoded
from fieldlens.schemas import ANNOTATION_TASK
from fieldlens.session import io_tasks
from fieldlens.sources.files import open_fs, read_bytes
from fieldlens.sources.jobs import write_files
from fieldlens.sources.json_ranges import json_elements, json_lines, json_members


def _parsed(column: str | Column, schema: str) -> Column:
    """A JSON text as a value; text that is not of this form fails the job instead of becoming null."""
    return F.from_json(column, schema, {"mode": "FAILFAST"})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").rlike(r"\S"))


def _one(value: str | Column, kind: str) -> Column:
    """A JSON value of any kind, also a number or a text by itself."""
    return _parsed(F.concat(F.lit('{"v":'), value, F.lit("}")), f"v {kind}")["v"]


def map_rows(df: DataFrame, column: str, value_type: str = "string", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, value) rows of a JSON object column."""
    return df.select(*keep, F.explode(_parsed(column, f"map<string,{value_type}>")).alias("key", "value"))


def read_json_map(spark: SparkSession, path: str, value_type: str = "string", one_document: bool = False) -> DataFrame:
    """A {key: value} file as a lookup table: one object per line, or per file with ``one_document`` (of any layout).

    Either is read in ranges by many tasks. A line or file that cannot be parsed fails the job.
    """
    if one_document:
        return json_members(spark, path).select("key", _one("value", value_type).alias("value"))
    return map_rows(_lines(spark, path), "value", value_type)


def write_json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """One single-entry object per line, so that large maps stay splittable."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value")).write.text(path)


def read_key_list(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """A JSON array of keys as a one-column table; numbers in quotes count as numbers."""
    if one_document:
        keys = json_elements(spark, path).select(_one("value", "string").alias("k"))
    else:
        keys = _lines(spark, path).select(F.explode(_parsed("value", "array<string>")).alias("k"))
    return keys.select(F.col("k").cast("double").cast("bigint").alias("key"))


def annotation_json_scan(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """task_id, data, annotations of annotation tasks as they are exported: a JSON array with ``one_document``, else a task a line.

    Both are read in ranges by many tasks. ``task_id`` is the place of a task in the file and, over several files, in the
    order of their paths. Other forms fail.
    """
    rows = json_elements(spark, path) if one_document else json_lines(spark, path)
    return rows.select(F.col("position").alias("task_id"), _parsed("value", ANNOTATION_TASK).alias("t")).select("task_id", "t.*")


def write_json_array(rows: DataFrame, path: str) -> None:
    """Every partition as a file with one JSON array, an indented element a line."""

    def lay_out(batches):
        before = "[\n"
        for b in batches:
            texts = b.column("value").to_pylist()
            if texts:
                text = before + ",\n".join("  " + t for t in texts)
                before = ","
                yield pa.RecordBatch.from_arrays([pa.array([text])], names=["value"])
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    listed = rows.select(F.to_json(F.struct("*")).alias("value"))
    listed.mapInArrow(lay_out, "value string").write.text(path)


def metadata_projection(*columns: str, missing: str | None = None) -> Column:
    """Chosen columns as a JSON object; nulls stay null or print as ``missing``."""
    if missing is None:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns]))


def _by_image(spark: SparkSession, path: str, one_document: bool) -> DataFrame:
    """image, v: the lists of every image of {image: lists} files as a variant."""
    if one_document:
        rows = json_members(spark, path)
    else:
        rows = map_rows(_lines(spark, path), "value", "string")
    return rows.select(F.col("key").alias("image"), F.parse_json("value").alias("v"))


def _lists(rows: DataFrame, sizes: tuple[int, ...], kinds: dict[str, str]) -> DataFrame:
    """The lists of an image as columns; another number of lists, or a list of another kind, fails the job."""
    n = F.size(F.variant_get("v", "$", "array<variant>"))
    other = F.raise_error(F.concat(F.lit("malformed predictions: unknown form of image "), "image")).cast("int")
    rows = rows.withColumn("_n", F.when(n.isin(*sizes), n).otherwise(other))
    return rows.select("image", *[F.when(F.col("_n") > i, F.variant_get("v", f"$[{i}]", kind)).alias(c) for i, (c, kind) in enumerate(kinds.items())])


def _boxes(rows: DataFrame, lists: list[str], start: Column, optional: tuple[str, ...] = ()) -> DataFrame:
    """A row per box; lists of unequal length fail the job."""
    n = F.size("box")
    same = F.lit(True)
    for c in lists:
        same = same & (F.coalesce(F.size(c) == n, F.lit(c in optional)))
    wrong = F.raise_error(F.concat(F.lit("lists of unequal length for image "), "image")).cast("array<array<double>>")
    rows = rows.withColumn("box", F.when(same, F.col("box")).otherwise(wrong)).select(
        "image", start.alias("_start"), "box", *[F.coalesce(c, F.transform("box", lambda b: F.lit(None))).alias(c) if c in optional else c for c in lists]
    )
    rows = rows.select("image", "_start", F.posexplode(F.arrays_zip("box", *lists)).alias("_p", "b"))
    return rows.select(
        "image", (F.col("_start") + F.col("_p")).cast("int").alias("pos"),
        *[F.col("b.box")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], *[F.col("b")[c].alias(c) for c in lists],
    )


def prediction_json_scan(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """One row per box of {image: [boxes, labels, scores]} files; scores may be missing, as in ground truth.

    A fourth list holds the position at which the arrays begin in their image. Lists of unequal length, other forms and
    text that cannot be parsed fail the job.
    """
    kinds = {"box": "array<array<double>>", "label": "array<bigint>", "score": "array<double>", "start": "array<bigint>"}
    read = _lists(_by_image(spark, path, one_document), (2, 3, 4), kinds)
    return _boxes(read, ["label", "score"], F.coalesce(F.col("start")[0], F.lit(0)), ("score",))


def classified_boxes_scan(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """One row per box of {image: [boxes, labels, classes, subclasses, confidences]} files, as classifiers of trap images write
    them and tracking reads them: image, pos, x1, y1, x2, y2, label, class, subclass, confidence. Other forms fail."""
    kinds = {"box": "array<array<double>>", "label": "array<bigint>", "class": "array<string>", "subclass": "array<string>", "confidence": "array<double>"}
    read = _lists(_by_image(spark, path, one_document), (5,), kinds)
    return _boxes(read, ["label", "class", "subclass", "confidence"], F.lit(0))


def detector_results_scan(spark: SparkSession, path: str) -> DataFrame:
    """image, pos, category, conf, x, y, width, height of every box in {"images": [{"file", "detections": [{"conf", "bbox"}]}]} files.

    One file is read in ranges by many tasks. Images without detections, or with none because they failed, have no row;
    an image without a file name or a box without four numbers fails the job.
    """
    records = json_elements(spark, path, level=2).filter(F.col("value").startswith("{")).select(F.parse_json("value").alias("v"))
    named = records.select(F.variant_get("v", "$.file", "string").alias("image"), F.variant_get("v", "$.detections", "array<variant>").alias("d"))
    wrong = F.raise_error(F.lit("malformed detections: an image without a file")).cast("string")
    boxes = named.select(F.coalesce("image", wrong).alias("image"), F.posexplode("d").alias("pos", "d"))
    box = F.variant_get("d", "$.bbox", "array<double>")
    short = F.raise_error(F.concat(F.lit("malformed detections: a box of "), "image")).cast("array<double>")
    rows = boxes.select(
        "image", "pos", F.variant_get("d", "$.category", "string").alias("category"), F.variant_get("d", "$.conf", "double").alias("conf"),
        F.when(F.size(box) == 4, box).otherwise(short).alias("b"),
    )
    return rows.select("image", "pos", "category", "conf", *[F.col("b")[i].alias(c) for i, c in enumerate(("x", "y", "width", "height"))])


def crop_records_scan(spark: SparkSession, path: str) -> DataFrame:
    """image, pos, gt, gt_rank, binary, xc, yc, w, h, predictions (name and conf, best first) of crop records: one JSON array of
    {"ground_truth", "binary_classification", "moth_classification", "bbox_coordinates"} an image, named by its file.

    Crops that needed no classification have null predictions. A record without ground truth, and another form, fails the job.
    """
    records = json_elements(spark, path).select("path", "position", F.parse_json("value").alias("v"))
    first = records.groupBy("path").agg(F.min("position").alias("_first")).withColumnRenamed("path", "_path")
    # merged: the planner would take the records for as small as the list of their ranges
    records = records.join(first.hint("merge"), F.col("path") == F.col("_path"))
    truth = F.variant_get("v", "$.ground_truth", "array<string>")
    wrong = F.raise_error(F.concat(F.lit("malformed crop record in "), "path")).cast("array<string>")
    ranked = F.variant_get("v", "$.moth_classification", "variant")
    pairs = F.transform(
        F.when(F.schema_of_variant(ranked).startswith("ARRAY"), F.variant_get("v", "$.moth_classification", "array<array<variant>>")),
        lambda p: F.struct(F.variant_get(p[0], "$", "string").alias("name"), F.variant_get(p[1], "$", "double").alias("conf")),
    )
    box = F.variant_get("v", "$.bbox_coordinates", "array<double>")
    rows = records.select(
        decoded(F.substring_index("path", "/", -1)).alias("_f"), (F.col("position") - F.col("_first")).cast("int").alias("pos"),
        F.when(F.size(truth) == 2, truth).otherwise(wrong).alias("t"),
        F.variant_get("v", "$.binary_classification", "string").alias("binary"), box.alias("b"), pairs.alias("predictions"),
    )
    return rows.select(
        F.regexp_replace("_f", r"\.[^.]*$", "").alias("image"), "pos", F.col("t")[0].alias("gt"), F.col("t")[1].alias("gt_rank"), "binary",
        *[F.col("b")[i].alias(c) for i, c in enumerate(("xc", "yc", "w", "h"))], "predictions",
    )


def write_prediction_json(nested: DataFrame, path: str) -> None:
    """``nested_regroup`` rows as one single-image object per line, the fourth list being the row's start."""
    name = F.regexp_replace(F.to_json(F.array(F.col("image").cast("string"))), r"^\[|\]$", "")
    lists = F.concat_ws(", ", F.to_json("boxes"), F.to_json("labels"), F.to_json("scores"), F.to_json(F.array("start")))
    nested.select(F.concat(F.lit("{"), name, F.lit(": ["), lists, F.lit("]}")).alias("value")).write.text(path)


def yolo_label_scan(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of ``id x y w h`` text files, the image being the file name."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", decoded("_metadata.file_name").alias("f"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select(F.regexp_replace("f", r"\.[^.]*$", "").alias("image"), parts.alias("p"))
    return rows.select(
        "image", F.col("p")[0].cast("int").alias("class_id"),
        *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"), start=1)],
    )


def text_files_sink(texts: DataFrame, root: str, extension: str) -> int:
    """``<image><extension>`` with the content of every row (image, content) below ``root``; the number of files."""
    rows = texts.select(F.concat("image", F.lit(extension)).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return write_files(rows, root, "path", "content")


def yolo_label_sink(texts: DataFrame, root: str) -> int:
    """``<image>.txt`` per photograph below ``root``; returns the number of files."""
    return text_files_sink(texts, root, ".txt")


def text_files_scan(names: DataFrame, root: str, extension: str) -> DataFrame:
    """(image, content) of the small text files ``<image><extension>`` below ``root``, empty ones included; a file that
    is not there fails the job."""

    def read(batches):
        fs, base = open_fs(root)
        for b in batches:
            stems = b.column("image").to_pylist()
            texts = [read_bytes(fs, f"{base}/{stem}{extension}") for stem in stems]
            yield pa.RecordBatch.from_arrays([b.column("image"), pa.array(texts, pa.binary()).cast(pa.string())], names=["image", "content"])

    return names.select("image").repartition(io_tasks(names.sparkSession)).mapInArrow(read, "image string, content string")
