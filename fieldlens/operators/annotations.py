"""Nested annotation tasks: effective items, labels, YOLO rows and statistics.

A task is one photograph and arrives as one nested row, so its items are worked on inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions import boxes as bx
from fieldlens.functions.arrays import let
from fieldlens.functions.names import base_name, file_stem, region_of_deployment


def _effective() -> Column:
    first = F.col("annotations")[0]
    review = F.get(first["reviews"], F.lit(0))
    fixed = F.coalesce(F.size(review["fixed_annotation_history"]) > 0, F.lit(False))
    return F.when(fixed, review["fixed_annotation_history_result"]).otherwise(first["result"])


def resolve_review(tasks: DataFrame) -> DataFrame:
    """Tasks with ``items`` and their places: the reviewer's result when a fix history exists, the annotator's otherwise."""
    placed = F.transform(
        _effective(), lambda x, i: F.struct(i.cast("long").alias("pos"), x["id"].alias("id"), x["type"].alias("type"), x["value"].alias("value"))
    )
    return tasks.select("task_id", "data", placed.alias("items"))


def _of(items: Column, kind: str) -> Column:
    return F.filter(items, lambda x: x["type"] == kind)


def _deepest(paths: Column) -> Column:
    """Last name of the longest path; the later one among equals."""
    longest = F.array_max(F.transform(paths, lambda p, i: F.struct(F.size(p).alias("n"), i.alias("i"), p.alias("p"))))
    return F.element_at(longest["p"], -1)


def deepest_taxon_label(resolved: DataFrame) -> DataFrame:
    """One label per labelled box: taxonomy items first, coarse labels only where no taxonomy item shares the id."""
    ids = F.transform(_of(F.col("items"), "taxonomy"), lambda x: x["id"])

    def wanted(known: Column) -> Column:
        return F.filter(
            "items",
            lambda x: (x["type"] == "taxonomy")
            | ((x["type"] == "labels") & ~F.array_contains(known, x["id"])
               & F.coalesce(F.get(x["value"]["labels"], F.lit(0)) != "Unclassified", F.lit(False))),
        )

    rows = resolved.select("task_id", "data", F.explode(let(ids, wanted)).alias("item"))
    value = F.col("item.value")
    label = F.when(F.col("item.type") == "taxonomy", _deepest(value["taxonomy"])).otherwise(F.get(value["labels"], F.lit(0)))
    return rows.select(
        "task_id", F.col("data.image").alias("image"), F.col("data.deployment").alias("deployment"),
        F.col("item.id").alias("item_id"), F.col("item.pos").alias("pos"), F.col("item.type").alias("type"),
        label.alias("label"), value["x"].alias("x"), value["y"].alias("y"), value["width"].alias("width"),
        value["height"].alias("height"),
    )


def _number(raw: Column) -> Column:
    """A capped, rounded fraction as the label files print it."""
    v = F.round(F.least(raw, F.lit(1.0)), 5)
    tiny = F.concat(F.round(v * 100000).cast("int").cast("string"), F.lit("e-05"))
    return F.when(raw > 1, "1").when((v > 0) & (v < 0.0001), tiny).otherwise(v.cast("string"))


def yolo_lines(labels: DataFrame, categories: DataFrame) -> DataFrame:
    """(image, line) with ``id x y w h`` per labelled box; a label without a category fails the job."""
    known = categories.select(F.col("category").alias("label"), "class_id")
    joined = labels.join(known, "label", "left")
    class_id = F.when(
        F.col("class_id").isNull(),
        F.raise_error(F.concat(F.coalesce("label", F.lit("null")), F.lit(" has no category"))).cast("long"),
    ).otherwise(F.col("class_id"))
    w, h = F.col("width"), F.col("height")
    numbers = [(F.col("x") + w / 2) / 100, (F.col("y") + h / 2) / 100, w / 100, h / 100]
    line = F.concat_ws(" ", class_id.cast("string"), *[_number(n) for n in numbers])
    return joined.select("task_id", "image", "type", "pos", line.alias("line"))


def yolo_files(lines: DataFrame, tasks: DataFrame, order: str = "task_id") -> DataFrame:
    """(image, content): one label text per photograph of ``tasks``, taxonomy lines first, empty where nothing is labelled;
    of two tasks for one photograph the later one stays."""
    line = F.struct((F.col("type") != "taxonomy").alias("coarse"), "pos", "line")
    per_task = lines.groupBy(F.col(order).alias("_o")).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    named = tasks.select(order, file_stem("data.image").alias("image"))
    text = F.concat(F.array_join(F.col("_l.line"), "\n"), F.lit("\n"))
    every = named.join(per_task, F.col(order) == F.col("_o"), "left").withColumn("_text", F.coalesce(text, F.lit("")))
    return every.groupBy("image").agg(F.max_by("_text", order).alias("content"))


def region_sidecars(tasks: DataFrame, sizes: DataFrame, order: str = "task_id") -> DataFrame:
    """(image, content): the region and size of every photograph as indented JSON; of two tasks the later one stays.

    ``sizes`` has image (the file stem), width and height. A deployment of no known region and a photograph without a
    size fail the job.
    """
    region = region_of_deployment("data.deployment")
    unknown = F.raise_error(F.concat(F.lit("no region is known of "), F.coalesce("data.deployment", F.lit("null")))).cast("string")
    placed = tasks.select(file_stem("data.image").alias("image"), order, F.coalesce(region, unknown).alias("region"))
    last = placed.groupBy("image").agg(F.max_by("region", order).alias("region"))
    sized = last.join(sizes.select(F.col("image").alias("_image"), "width", "height"), F.col("image") == F.col("_image"), "left")
    missing = F.raise_error(F.concat(F.lit("no size is known of "), "image")).cast("string")
    fields = [
        F.concat(F.lit('  "region": "'), "region", F.lit('"')),
        *[F.concat(F.lit(f'  "image_{c}": '), F.coalesce(F.col(c).cast("string"), missing)) for c in ("width", "height")],
    ]
    return sized.select("image", F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit("\n}")).alias("content"))


def yolo_boxes(labels: DataFrame) -> DataFrame:
    return labels.select("*", *bx.percent_to_yolo())


def annotation_statistics(resolved: DataFrame, taxa: DataFrame, order: str = "task_id") -> DataFrame:
    """(counter, value): boxes, coarse labels, taxonomy labels per rank and tasks per place.

    A photograph listed twice counts once for the place its later copies name when that is Denmark.
    """
    items = F.col("items")
    labels, taxonomy = _of(items, "labels"), _of(items, "taxonomy")
    first = F.transform(labels, lambda x: F.get(x["value"]["labels"], F.lit(0)))

    def n_of(name: str) -> Column:
        return F.size(F.filter(first, lambda v: v == name))

    label_ids = F.transform(labels, lambda x: x["id"])
    direct = let(label_ids, lambda ids: F.size(F.filter(taxonomy, lambda x: ~F.array_contains(ids, x["id"]))))
    per_task = resolved.select(
        F.size(_of(items, "rectangle")).alias("boxes"),
        F.size(labels).alias("labels"),
        n_of("Non-Moth").alias("nonmoths"),
        n_of("Moth").alias("coarse_moths"),
        n_of("Unidentifiable").alias("unidentify"),
        F.size(F.filter(first, lambda v: v.isNull())).alias("empty"),
        direct.alias("moths_dir_label"),
        F.size(F.filter(taxonomy, lambda x: F.size(x["value"]["taxonomy"]) > 1)).alias("mul_label"),
    )
    sums = per_task.agg(*[F.sum(c).alias(c) for c in per_task.columns])
    counters = {
        "boxes": F.col("boxes"), "labels": F.col("labels"), "nonmoths": F.col("nonmoths"),
        "moths": F.col("coarse_moths") + F.col("moths_dir_label"), "unidentify": F.col("unidentify"),
        "unclassify": F.col("empty") + F.col("boxes") - F.col("labels") - F.col("moths_dir_label"),
        "mul_label": F.col("mul_label"), "moths_dir_label": F.col("moths_dir_label"),
    }
    wide = F.array(*[F.struct(F.lit(k).alias("counter"), v.cast("long").alias("value")) for k, v in counters.items()])
    base = sums.select(F.explode(wide).alias("c")).select("c.*")

    # every path that adds names the deepest one lacks, and the deepest one
    def counted(paths: Column) -> Column:
        by_depth = F.array_sort(F.transform(paths, lambda p, i: F.struct(F.size(p).alias("n"), i.alias("i"), p.alias("p"))))
        return let(
            by_depth,
            lambda s: F.flatten(
                F.transform(
                    F.filter(s, lambda e, i: (i == F.size(s) - 1) | (F.size(F.array_except(e["p"], F.element_at(s, -1)["p"])) > 0)),
                    lambda e: e["p"],
                )
            ),
        )

    names = resolved.select(F.explode(taxonomy).alias("t")).select(F.explode(counted(F.col("t.value.taxonomy"))).alias("name"))
    ranks = (
        names.groupBy("name").agg(F.count("*").alias("n")).join(taxa, "name").groupBy("rank")
        .agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
    )
    pairs = F.array(
        F.struct(F.concat(F.lit("labels_"), F.lower("rank")).alias("counter"), F.col("n").alias("value")),
        F.struct(F.concat(F.lit("taxa_"), F.lower("rank")).alias("counter"), F.col("distinct").alias("value")),
    )
    rank_rows = ranks.select(F.explode(pairs).alias("c")).select("c.*")

    place = F.lit(None).cast("string")
    # fixed values
    for name in reversed(("Panama", "UK", "Quebec", "Denmark", "Vermont")):
        place = F.when(F.col("data.deployment").contains(name), name).otherwise(place)
    placed = resolved.select(
        F.col(order).alias("_o"), base_name(F.col("data.image")).alias("_img"), place.alias("place"),
        F.col("data.deployment").contains("Denmark").alias("_dk"),
    )
    # later copies from Denmark are taken back, so only a first copy counts there
    copies = placed.groupBy("_img").agg(
        F.min_by("_dk", "_o").alias("_first_dk"), F.count_if("_dk").alias("_n_dk")
    )
    back = copies.agg(F.coalesce(F.sum(F.col("_n_dk") - F.when(F.col("_first_dk"), 1).otherwise(0)), F.lit(0))).scalar()
    places = placed.dropna(subset=["place"]).groupBy("place").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("tasks_"), F.lower("place")).alias("counter"),
        (F.col("n") - F.when(F.col("place") == "Denmark", back).otherwise(0)).alias("value"),
    )
    return base.unionByName(rank_rows).unionByName(places)
