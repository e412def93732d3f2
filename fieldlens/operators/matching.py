"""Detection matching, precision-recall curves and average precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import boxes as bx
from fieldlens.operators.ordering import running_sums, suffix_maxima

EPS = 2.220446049250313e-16
COORDS = ("x1", "y1", "x2", "y2")


def _cells(df: DataFrame, by: Sequence[str], prefix: str, cell: int, carry: Sequence[str]) -> DataFrame:
    """One row per grid cell a box touches."""
    span = [
        F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)) for lo, hi in (("x1", "x2"), ("y1", "y2"))
    ]
    named = df.select(
        *by, *[F.col(c).alias(f"{prefix}{c}") for c in (*COORDS, *carry)], span[0].alias("_xs"), span[1].alias("_ys")
    )
    return named.withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys")).drop("_xs", "_ys")


def box_pair_join(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str] = ("image",),
    min_iou: float = 0.0,
    carry_a: Sequence[str] = ("box_id",),
    carry_b: Sequence[str] = ("box_id",),
    cell: int = 256,
) -> DataFrame:
    """Overlapping pairs of two box tables within a group, with their ``iou``.

    Pairs meet in grid cells, so an image holding a third of all boxes spreads over its cells and pairs that
    cannot overlap are never formed. A pair is kept only in the cell of its overlap's corner, once.
    """
    by = list(by)
    left, right = _cells(a, by, "a_", cell, carry_a), _cells(b, by, "b_", cell, carry_b)
    corner = (F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("_cx")) & (
        F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("_cy")
    )
    touch = (
        (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2"))
        & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2"))
    )
    pairs = left.join(right, [*by, "_cx", "_cy"]).filter(corner & touch).withColumn("iou", bx.iou())
    return pairs.filter(F.col("iou") >= min_iou).drop("_cx", "_cy")


def _greedy(by: list[str], thresholds: list[float]):
    """Greedy pass over pairs that come image by image, in the order of the pass. Beside the pair at hand only the
    truths that are taken are held, a set for each threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, det, matched, taken = None, None, [], []
        for b in batches:
            rows, slots = [], []
            keys = zip(*(b.column(c).to_pylist() for c in by), strict=True) if by else [()] * len(b)
            for i, (key, d, gt, iou) in enumerate(zip(keys, *(b.column(c).to_pylist() for c in ("det", "gt", "iou")), strict=True)):
                if key != group:
                    group, det, taken = key, None, [set() for _ in thresholds]
                if det is None or d != det[0]:
                    det, matched = (d,), [False] * len(thresholds)
                for k, threshold in enumerate(thresholds):
                    if iou >= threshold and not matched[k] and gt not in taken[k]:
                        matched[k] = True
                        taken[k].add(gt)
                        rows.append(i)
                        slots.append(k)
            if rows:
                at = pa.array(rows)
                columns = [b.column(c).take(at) for c in (*by, "det", "gt", "iou")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(slots, pa.int32())], names=[*by, "det", "gt", "iou", "slot"])

    return run


def _matched_slots(pairs: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    """by, det, gt, iou, slot (place of the threshold) of the greedy matches."""
    levels = [float(t) for t in thresholds]
    # the best truth of the best detection first; ties by id
    laid = pairs.filter(F.col("iou") >= min(levels)).select(*by, "det", "gt", "score", "iou").repartition(*by)
    laid = laid.sortWithinPartitions(*by, F.desc("score"), "det", F.desc("iou"), "gt")
    kept = laid.select(*by, "det", "gt", "iou")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", slot int"
    return kept.mapInArrow(_greedy(list(by), levels), schema)


def greedy_box_match(pairs: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("image",)) -> DataFrame:
    """Matches (by, threshold, det, gt, iou): by falling score each detection takes its best free truth.

    ``pairs``: by, det, gt, score, iou. One shuffle for all thresholds; the pairs of an image, sorted by score with spilling,
    pass through one task as a stream, which holds the truths that are taken.
    """
    found = _matched_slots(pairs, thresholds, by)
    level = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("slot") + 1)
    return found.select(*by, level.alias("threshold"), "det", "gt", "iou")


def _overlaps(detections: DataFrame, truths: DataFrame, thresholds: Sequence[float], by: Sequence[str]) -> DataFrame:
    pairs = box_pair_join(detections, truths, by, min(thresholds), ("box_id", "score"), ("box_id",))
    return pairs.select(*by, F.col("a_box_id").alias("det"), F.col("b_box_id").alias("gt"), F.col("a_score").alias("score"), "iou")


def match_detections(
    detections: DataFrame, truths: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("image",)
) -> DataFrame:
    """Pairs, then the greedy matches; boxes carry ``box_id`` and detections ``score``."""
    return greedy_box_match(_overlaps(detections, truths, thresholds, by), thresholds, by)


def _curve(
    detections: DataFrame, truths: DataFrame, truth_counts: DataFrame, thresholds: Sequence[float], by: Sequence[str], group: Sequence[str]
) -> DataFrame:
    """Detections in score order with a slot for each threshold: hits, running hits ``tp`` and precision (the envelope),
    beside the running count ``n`` and ``n_gt``. The rows are not multiplied by the thresholds."""
    group, slots = list(group), range(len(thresholds))
    matches = _matched_slots(_overlaps(detections, truths, thresholds, by), thresholds, by)
    hits = matches.groupBy(*by, "det").agg(*[F.max((F.col("slot") == i).cast("int")).alias(f"h{i}") for i in slots])
    # by this key matches lie as the pairs did, one row a detection that has any
    marked = detections.select(*by, F.col("box_id").alias("det"), "score").join(hits, [*by, "det"], "left")
    marked = marked.select(*group, "image", "det", "score", *[F.coalesce(f"h{i}", F.lit(0)).alias(f"h{i}") for i in slots])
    order = [F.col("score").desc(), F.col("det"), F.col("image")]
    summed = running_sums(marked, group, order, {"n": F.lit(1), **{f"t{i}": F.col(f"h{i}") for i in slots}})
    raw = summed.withColumns({f"r{i}": F.col(f"t{i}") / (F.col("n") + EPS) for i in slots})
    enveloped = suffix_maxima(raw, group, {f"p{i}": f"r{i}" for i in slots})
    counted = enveloped.join(truth_counts, group) if group else enveloped.withColumn("n_gt", truth_counts.scalar())
    return counted.select(
        *group, "image", "det", "score", "n", "n_gt", *[F.array(*[F.col(f"{c}{i}") for i in slots]).alias(o) for c, o in (("h", "hit"), ("t", "tp"), ("p", "precision"))]
    )


def pr_curve(
    detections: DataFrame, truths: DataFrame, thresholds: Sequence[float] = (0.5, 0.75), count_all_truths: bool = False
) -> DataFrame:
    """Precision (non-increasing envelope) and recall down the score order, per IoU threshold.

    Recall counts truths of images that have detections, or of all images with ``count_all_truths``.
    """
    base = truths if count_all_truths else truths.join(detections.select("image").distinct(), "image", "left_semi")
    curve = _curve(detections, truths, base.agg(F.count("*").alias("n_gt")), thresholds, ("image",), ())
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    points = curve.select("image", "det", "score", "n", "n_gt", F.explode(F.arrays_zip(levels.alias("threshold"), "hit", "tp", "precision")).alias("s"))
    return points.select(
        "s.threshold", "image", "det", "score", "s.hit", "s.tp", (F.col("n") - F.col("s.tp")).alias("fp"), "n_gt", "s.precision",
        (F.col("s.tp") / (F.col("n_gt") + EPS)).alias("recall"),
    )


def operating_point(curve: DataFrame, score: float) -> DataFrame:
    """Last point of the curve at or above a score."""
    point = F.max_by(F.struct("score", "precision", "recall"), F.col("tp") + F.col("fp"))
    return (
        curve.filter(F.col("score") >= score).groupBy("threshold").agg(point.alias("p")).select("threshold", "p.*")
    )


def best_boxes(preds: DataFrame, max_boxes: int, by: Sequence[str] = ("image",)) -> DataFrame:
    """The ``max_boxes`` best boxes per image, lower id first on ties.

    A rank filter with a constant limit is cut per map task before the shuffle, so a crowded image sends at
    most ``max_boxes`` rows from each task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "box_id")
    return preds.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_boxes).drop("_r")


def topk_boxes(preds: DataFrame, score_thr: float, max_boxes: int, by: Sequence[str] = ("image",)) -> DataFrame:
    """Best boxes above a score, with whole-pixel corners."""
    best = best_boxes(preds.filter(F.col("score") > score_thr), max_boxes, by)
    return best.select(*[F.round(c).cast("int").alias(c) if c in COORDS else F.col(c) for c in best.columns])


def mean_average_precision(
    detections: DataFrame, truths: DataFrame, max_boxes: int = 100, label: str = "label"
) -> DataFrame:
    """mAP over IoU .50-.95, mAP50 and mAP75 over the classes present in the truths.

    The k-th true positive answers the recall points j/100 in ((k-1)/n, k/n], so the 101-point mean is a
    weighted sum over true positives.
    """
    thresholds = [round(0.5 + 0.05 * i, 2) for i in range(10)]
    by, group = ("image", label), (label,)
    top = best_boxes(detections, max_boxes, by)
    counts = truths.groupBy(label).agg(F.count("*").alias("n_gt"))
    curve = _curve(top, truths, counts, thresholds, by, group)
    n = F.col("n_gt")

    def points(k: Column) -> Column:
        return F.floor(k * 100 / n) - F.floor((k - 1) * 100 / n) + F.when(k == 1, 1).otherwise(0)

    sums = [
        F.sum(F.when(F.col("hit")[i] == 1, points(F.col("tp")[i]) * F.col("precision")[i]).otherwise(0.0) / 101).alias(f"a{i}")
        for i in range(len(thresholds))
    ]
    ap = counts.select(label).join(curve.groupBy(label).agg(*sums), label, "left")
    scored = ap.select(*[F.coalesce(f"a{i}", F.lit(0.0)).alias(f"a{i}") for i in range(len(thresholds))])
    every = F.array(*[F.avg(f"a{i}") for i in range(len(thresholds))])
    means = scored.agg(every.alias("m"))
    at = {t: i for i, t in enumerate(thresholds)}
    return means.select(
        F.round(F.aggregate("m", F.lit(0.0), lambda s, v: s + v) / len(thresholds), 6).alias("map"),
        F.round(F.col("m")[at[0.5]], 6).alias("map_50"), F.round(F.col("m")[at[0.75]], 6).alias("map_75"),
    )


def best_detection(detections: DataFrame, image: str = "image") -> DataFrame:
    """Highest confidence box per image, first one on ties; boxes without confidence never win."""
    usable = detections.filter(F.col("conf") > 0)
    best = F.max_by(F.struct("pos", "conf", "x", "y", "width", "height"), F.struct(F.col("conf"), -F.col("pos")))
    return usable.groupBy(image).agg(best.alias("b")).select(image, "b.*")


def nested_regroup(boxes: DataFrame, chunk: int | None = None) -> DataFrame:
    """Boxes, labels and scores as parallel arrays per image, best score first, and ``start`` 0.

    With ``chunk`` an image with more boxes continues in further rows, so that no row holds an unbounded image; ``start``
    then says at which position of its image a row's arrays begin.
    """
    item = F.struct((-F.col("score")).alias("_s"), "box_id", F.array(*COORDS).alias("box"), "label", "score")
    placed = boxes.withColumn("start", F.lit(0).cast("long"))
    if chunk is not None:
        ranks = running_sums(boxes, ["image"], [F.desc("score"), F.col("box_id")], {"_r": F.lit(1)})
        placed = ranks.withColumn("start", (F.floor((F.col("_r") - 1) / chunk) * chunk).cast("long"))
    rows = placed.groupBy("image", "start").agg(F.sort_array(F.collect_list(item)).alias("_i"))
    return rows.select("image", "start", F.col("_i.box").alias("boxes"), F.col("_i.label").alias("labels"), F.col("_i.score").alias("scores"))
