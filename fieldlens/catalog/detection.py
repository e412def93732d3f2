"""Box, matching and tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.catalog import query
from fieldlens.functions import arrays
from fieldlens.functions import boxes as bx
from fieldlens.operators import filters, matching, tracking
from fieldlens.plans.fixtures import with_views

DET = with_views("det_boxes", "gt_boxes")
OVERLAP = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1){p}) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1){p})"
AREA = "(({b}.x2 - {b}.x1{p}) * ({b}.y2 - {b}.y1{p}))"


def _iou_sql(a: str, b: str, inclusive: bool = False) -> str:
    p = " + 1" if inclusive else ""
    inter = OVERLAP.format(a=a, b=b, p=p)
    ratio = f"({inter}) / ({AREA.format(b=a, p=p)} + {AREA.format(b=b, p=p)} - {inter})"
    return f"round({ratio}, 2)" if inclusive else ratio


def _match_sql(thresholds: str, by: str = "image") -> str:
    """Greedy matching as a recursion over the score order, oracle only. Needs det_ and gt_ with a column g."""
    return f""",
 pairs_ AS MATERIALIZED (SELECT d.g, d.box_id AS det, t.box_id AS gt, {_iou_sql('d', 't')} AS iou FROM det_ d JOIN gt_ t ON d.g = t.g WHERE {_iou_sql('d', 't')} > 0),
 order_ AS MATERIALIZED (SELECT d.g, h.threshold, d.box_id AS det, d.score, row_number() OVER (PARTITION BY d.g, h.threshold ORDER BY d.score DESC, d.box_id) AS rn
            FROM det_ d, (SELECT unnest({thresholds}) AS threshold) h),
 pass_ AS (SELECT DISTINCT g, threshold, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det, CAST(NULL AS BIGINT) AS gt FROM order_
   UNION ALL SELECT r.g, r.threshold, r.rn + 1, CASE WHEN min(p.gt) IS NULL THEN r.used ELSE list_append(r.used, arg_min(p.gt, ROW(-p.iou, p.gt))) END,
      o.det, arg_min(p.gt, ROW(-p.iou, p.gt))
   FROM pass_ r JOIN order_ o ON o.g = r.g AND o.threshold = r.threshold AND o.rn = r.rn + 1
   LEFT JOIN pairs_ p ON p.g = r.g AND p.det = o.det AND p.iou >= r.threshold AND NOT list_contains(r.used, p.gt)
   GROUP BY r.g, r.threshold, r.rn, r.used, o.det),
 match_ AS MATERIALIZED (SELECT g, threshold, det, gt FROM pass_ WHERE gt IS NOT NULL)"""


MATCH = with_views("det_boxes", "gt_boxes", recursive=True) + """,
 det_ AS (SELECT image AS g, * FROM det_boxes), gt_ AS (SELECT image AS g, * FROM gt_boxes)""" + _match_sql("[0.5e0, 0.75e0]")
CURVE = MATCH + """,
 marked_ AS (SELECT o.threshold, o.g AS image, o.det, o.score, CASE WHEN m.gt IS NULL THEN 0 ELSE 1 END AS hit
             FROM order_ o LEFT JOIN match_ m ON m.g = o.g AND m.threshold = o.threshold AND m.det = o.det),
 cum_ AS (SELECT *, sum(hit) OVER w AS tp, sum(1 - hit) OVER w AS fp, count(*) OVER w AS n FROM marked_
          WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, det, image ROWS UNBOUNDED PRECEDING)),
 curve_ AS (SELECT *, max(tp / (tp + fp + 2.220446049250313e-16)) OVER (PARTITION BY threshold ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision,
            tp / ((SELECT count(*) FROM gt_boxes WHERE image IN (SELECT image FROM det_boxes)) + 2.220446049250313e-16) AS recall FROM cum_)"""


def _dets(t):
    return t.det_boxes.withColumn("label", F.lit(1))


@query("small_box_filter", DET + "SELECT image, box_id, x1, y1, x2, y2 FROM det_boxes WHERE x2 - x1 >= 55 AND y2 - y1 >= 55")
def small_box_filter(t):
    return filters.small_box_filter(t.det_boxes.select("image", "box_id", "x1", "y1", "x2", "y2"), 55)


@query("small_crop_filter", with_views("annotation_items") + """
SELECT conv_id, pos FROM annotation_items WHERE NOT (floor(width / 100 * 1280) < 120 AND floor(height / 100 * 720) < 120)""")
def small_crop_filter(t):
    crops = t.annotation_items.select("conv_id", "pos", (F.col("width") / 100).alias("w"), (F.col("height") / 100).alias("h"),
                                      F.lit(1280).alias("image_width"), F.lit(720).alias("image_height"))
    return filters.small_crop_filter(crops, 120).select("conv_id", "pos")


@query("topk_boxes", DET + """
SELECT image, box_id, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, score
FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS r FROM det_boxes WHERE score > 0.05e0) q WHERE r <= 5""")
def topk_boxes(t):
    return matching.topk_boxes(t.det_boxes, 0.05, 5)


@query("mask_area_filter", with_views("boxes") + """
SELECT image, box_id AS mask_id, x1, y1, x2, y2, CAST(1 AS INTEGER) AS label, round(least(1e0, sqrt((score * 1.5e0) * (0.9e0 + jitter / 50))), 6) AS score FROM boxes
WHERE NOT ((x2 - x1) * (y2 - y1) * (jitter / 5) > 640 * 480 * 0.02e0 OR (x2 - x1) * (y2 - y1) * (jitter / 5) < 640 * 480 * 0.0002e0)""")
def mask_area_filter(t):
    masks = t.boxes.select(
        "image", F.col("box_id").alias("mask_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"),
        (F.col("y2") - F.col("y1")).alias("h"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) * (F.col("jitter") / 5)).alias("area"),
        (F.col("score") * 1.5).alias("predicted_iou"), (F.lit(0.9) + F.col("jitter") / 50).alias("stability"),
        F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))
    return filters.mask_area_filter(masks, upper=0.02).withColumn("score", F.round("score", 6))


@query("preds_to_ground_truth", DET + """
SELECT image, box_id, x1, y1, x2, y2 FROM det_boxes WHERE score >= 0.4e0
UNION ALL SELECT image, NULL, NULL, NULL, NULL, NULL FROM det_boxes GROUP BY image HAVING max(score) < 0.4e0""")
def preds_to_ground_truth(t):
    kept, dropped = filters.preds_to_ground_truth(t.det_boxes, 0.4)
    return kept.unionByName(dropped, allowMissingColumns=True)


@query("box_geometry", with_views("annotation_items") + """,
 y_ AS (SELECT conv_id, pos, round(least((x + width / 2) / 100, 1e0), 5) AS xc, round(least((y + height / 2) / 100, 1e0), 5) AS yc,
               round(least(width / 100, 1e0), 5) AS w, round(least(height / 100, 1e0), 5) AS h FROM annotation_items),
 p_ AS (SELECT *, CAST(trunc((xc - w / 2) * 1280) AS INTEGER) AS x1, CAST(trunc((yc - h / 2) * 720) AS INTEGER) AS y1, CAST(trunc(w * 1280) AS INTEGER) AS wp,
               CAST(trunc(h * 720) AS INTEGER) AS hp FROM y_)
SELECT conv_id, pos, xc, yc, w, h, x1, y1, x1 + wp AS x2, y1 + hp AS y2, CAST(x1 + floor(wp / 2) AS BIGINT) AS cx, CAST(y1 + floor(hp / 2) AS BIGINT) AS cy,
 CAST(trunc(wp * hp * 100 / (1280 * 720)) AS INTEGER) AS share FROM p_""")
def box_geometry(t):
    yolo = t.annotation_items.select("conv_id", "pos", *bx.percent_to_yolo())
    px = yolo.select("*", *bx.yolo_to_pixels(image_width=F.lit(1280), image_height=F.lit(720)))
    return px.select("*", bx.centre("x1", "x2").alias("cx"), bx.centre("y1", "y2").alias("cy"), bx.box_share(F.lit(1280), F.lit(720)).alias("share"))


MEGA = """,
 m_ AS (SELECT image, box_id AS pos, CASE WHEN jitter < 2 THEN 0e0 ELSE round(score, 1) END AS conf, x1 / 700 AS x, y1 / 500 AS y, (x2 - x1) / 700 AS width, (y2 - y1) / 500 AS height FROM boxes),
 best_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, pos) AS r FROM m_ WHERE conf > 0) q WHERE r = 1)"""


def _mega(t):
    return t.boxes.select(
        "image", F.col("box_id").alias("pos"), F.when(F.col("jitter") < 2, 0.0).otherwise(F.round("score", 1)).alias("conf"),
        (F.col("x1") / 700).alias("x"), (F.col("y1") / 500).alias("y"), ((F.col("x2") - F.col("x1")) / 700).alias("width"),
        ((F.col("y2") - F.col("y1")) / 500).alias("height"))


@query("best_detection", with_views("boxes") + MEGA + "SELECT image, pos, conf, round(x, 6) AS x, round(y, 6) AS y FROM best_")
def best_detection(t):
    return matching.best_detection(_mega(t)).select("image", "pos", "conf", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("square_crop_box", with_views("boxes") + MEGA + """,
 c_ AS (SELECT *, x * 700 + width * 700 / 2 AS cx, y * 500 + height * 500 / 2 AS cy, greatest(width * 700, height * 500) * 1.2e0 / 2 AS half FROM best_)
SELECT image, pos, CAST(trunc(greatest(0e0, cx - half)) AS INTEGER) AS "left", CAST(trunc(greatest(0e0, cy - half)) AS INTEGER) AS upper,
 CAST(trunc(least(700e0, cx + half)) AS INTEGER) AS "right", CAST(trunc(least(500e0, cy + half)) AS INTEGER) AS lower FROM c_""")
def square_crop_box(t):
    crop = bx.square_crop_box("x", "y", "width", "height", F.lit(700), F.lit(500))
    return matching.best_detection(_mega(t)).select("image", "pos", *crop)


@query("box_pair_join", DET + f"""
SELECT d.image, d.box_id AS det, t.box_id AS gt, round({_iou_sql('d', 't')}, 6) AS iou FROM det_boxes d JOIN gt_boxes t ON d.image = t.image WHERE {_iou_sql('d', 't')} > 0""")
def box_pair_join(t):
    p = matching.box_pair_join(t.det_boxes, t.gt_boxes)
    return p.select("image", F.col("a_box_id").alias("det"), F.col("b_box_id").alias("gt"), F.round("iou", 6).alias("iou"))


@query("iou", DET + f"""
SELECT d.box_id, round({_iou_sql('d', 't')}, 6) AS iou, {_iou_sql('d', 't', True)} AS iou_pixels FROM det_boxes d JOIN gt_boxes t ON d.box_id = t.box_id""")
def iou(t):
    a = t.det_boxes.select("box_id", *[F.col(c).alias(f"a_{c}") for c in matching.COORDS])
    b = t.gt_boxes.select("box_id", *[F.col(c).alias(f"b_{c}") for c in matching.COORDS])
    return a.join(b, "box_id").select("box_id", F.round(bx.iou(), 6).alias("iou"), bx.iou(inclusive=True).alias("iou_pixels"))


@query("box_shape_distance", DET + f"""
SELECT d.box_id, round(least({AREA.format(b='d', p=' + 1')}, {AREA.format(b='t', p=' + 1')}) / greatest({AREA.format(b='d', p=' + 1')}, {AREA.format(b='t', p=' + 1')}), 6) AS ratio,
 round(sqrt(pow((t.x1 + (t.x2 - t.x1) / 2) - (d.x1 + (d.x2 - d.x1) / 2), 2) + pow((t.y1 + (t.y2 - t.y1) / 2) - (d.y1 + (d.y2 - d.y1) / 2), 2)) / 1000, 6) AS distance
FROM det_boxes d JOIN gt_boxes t ON d.box_id = t.box_id""")
def box_shape_distance(t):
    a = t.det_boxes.select("box_id", *[F.col(c).alias(f"a_{c}") for c in matching.COORDS])
    b = t.gt_boxes.select("box_id", *[F.col(c).alias(f"b_{c}") for c in matching.COORDS])
    return a.join(b, "box_id").select("box_id", F.round(bx.area_ratio(), 6).alias("ratio"), F.round(bx.centre_distance(diagonal=1000.0), 6).alias("distance"))


@query("greedy_box_match", MATCH + "SELECT g AS image, threshold, det, gt FROM match_")
def greedy_box_match(t):
    return matching.match_detections(t.det_boxes, t.gt_boxes, (0.5, 0.75)).select("image", "threshold", "det", "gt")


@query("pr_curve", CURVE + "SELECT threshold, image, det, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM curve_")
def pr_curve(t):
    return matching.pr_curve(t.det_boxes, t.gt_boxes).select(
        "threshold", "image", "det", "score", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("operating_point", CURVE + """
SELECT threshold, arg_max(score, n) AS score, round(arg_max(precision, n), 9) AS precision, round(arg_max(recall, n), 9) AS recall FROM curve_ WHERE score >= 0.25e0 GROUP BY threshold""")
def operating_point(t):
    p = matching.operating_point(matching.pr_curve(t.det_boxes, t.gt_boxes), 0.25)
    return p.select("threshold", "score", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("mean_average_precision", with_views("det_boxes", "gt_boxes", recursive=True) + """,
 det_ AS (SELECT image * 3 + box_id % 3 AS g, box_id % 3 AS label, * FROM det_boxes), gt_ AS (SELECT image * 3 + box_id % 3 AS g, box_id % 3 AS label, * FROM gt_boxes)"""
 + _match_sql("[0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]") + """,
 marked_ AS (SELECT o.threshold, o.g % 3 AS label, o.g // 3 AS image, o.det, o.score, CASE WHEN m.gt IS NULL THEN 0 ELSE 1 END AS hit
             FROM order_ o LEFT JOIN match_ m ON m.g = o.g AND m.threshold = o.threshold AND m.det = o.det),
 cum_ AS (SELECT *, sum(hit) OVER w AS tp, count(*) OVER w AS n FROM marked_ WINDOW w AS (PARTITION BY label, threshold ORDER BY score DESC, det, image ROWS UNBOUNDED PRECEDING)),
 curve_ AS (SELECT c.*, n_.n_gt, max(tp / (n + 2.220446049250313e-16)) OVER (PARTITION BY c.label, threshold ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS precision
            FROM cum_ c JOIN (SELECT label, count(*) AS n_gt FROM gt_ GROUP BY label) n_ ON n_.label = c.label),
 points_ AS (SELECT l.label, l.threshold, j, (SELECT 1) AS one FROM (SELECT DISTINCT label, threshold FROM curve_) l, (SELECT unnest(range(0, 101)) AS j) p),
 ap_ AS (SELECT p.label, p.threshold, p.j, coalesce(max(c.precision), 0) AS q FROM points_ p LEFT JOIN curve_ c ON c.label = p.label AND c.threshold = p.threshold
         AND c.tp * 100 >= p.j * c.n_gt GROUP BY 1, 2, 3),
 mean_ AS (SELECT label, threshold, avg(q) AS ap FROM ap_ GROUP BY 1, 2)
SELECT round(avg(ap), 6) AS map, round(avg(CASE WHEN threshold = 0.5e0 THEN ap END), 6) AS map_50, round(avg(CASE WHEN threshold = 0.75e0 THEN ap END), 6) AS map_75 FROM mean_""")
def mean_average_precision(t):
    label = (F.col("box_id") % 3).alias("label")
    return matching.mean_average_precision(t.det_boxes.select("*", label), t.gt_boxes.select("*", label))


@query("nested_regroup", DET + """
SELECT image, CAST(0 AS BIGINT) AS start, count(*) AS n, string_agg(concat_ws(' ', x1, y1, x2, y2), ';' ORDER BY score DESC, box_id) AS boxes FROM det_boxes GROUP BY image""")
def nested_regroup(t):
    lines = F.array_join(F.transform("boxes", lambda b: F.array_join(F.transform(b, lambda v: v.cast("string")), " ")), ";")
    return matching.nested_regroup(_dets(t)).select("image", "start", F.size("scores").cast("long").alias("n"), lines.alias("boxes"))


FEATURES = """,
 f_ AS MATERIALIZED (SELECT b.*, list_transform(e.embedding, lambda v: greatest(CAST(v AS DOUBLE), 0)) AS feature FROM frame_boxes b
        JOIN embeddings e ON e.vec_id = b.box_id % (SELECT count(*) FROM embeddings) WHERE class = 'moth')"""
FRAMES = with_views("frame_boxes", recursive=True) + FEATURES + f""",
 cost_ AS MATERIALIZED (SELECT c.deployment, c.frame, c.box_id AS cur, p.box_id AS prev,
     (1 - list_dot_product(p.feature, c.feature) / (sqrt(list_dot_product(p.feature, p.feature)) * sqrt(list_dot_product(c.feature, c.feature)))) + (1 - {_iou_sql('p', 'c', True)})
     + (1 - least({AREA.format(b='p', p=' + 1')}, {AREA.format(b='c', p=' + 1')}) / greatest({AREA.format(b='p', p=' + 1')}, {AREA.format(b='c', p=' + 1')}))
     + sqrt(pow((c.x1 + (c.x2 - c.x1) / 2) - (p.x1 + (p.x2 - p.x1) / 2), 2) + pow((c.y1 + (c.y2 - c.y1) / 2) - (p.y1 + (p.y2 - p.y1) / 2), 2)) / 1000 AS cost
     FROM f_ c JOIN f_ p ON p.deployment = c.deployment AND p.frame + 1 = c.frame)"""
# every complete one-to-one assignment of the (at most four) boxes is enumerated, the cheapest kept
ASSIGN = FRAMES + """,
 idx_ AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY deployment, frame ORDER BY cur) AS k FROM cost_),
 dim_ AS MATERIALIZED (SELECT deployment, frame, count(DISTINCT cur) AS n, count(DISTINCT prev) AS m FROM cost_ GROUP BY 1, 2),
 opt_ AS MATERIALIZED (SELECT deployment, frame, k, prev, cost FROM idx_ UNION ALL SELECT DISTINCT deployment, frame, k, -1, 0 FROM idx_),
 walk_ AS (SELECT deployment, frame, n, greatest(n - m, 0) AS skips, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS prevs, 0e0 AS total FROM dim_
   UNION ALL SELECT w.deployment, w.frame, w.n, CASE WHEN o.prev = -1 THEN w.skips - 1 ELSE w.skips END, w.k + 1, list_append(w.prevs, o.prev), w.total + o.cost
   FROM walk_ w JOIN opt_ o ON o.deployment = w.deployment AND o.frame = w.frame AND o.k = w.k + 1
     AND ((o.prev = -1 AND w.skips > 0) OR (o.prev <> -1 AND NOT list_contains(w.prevs, o.prev)))),
 best_ AS MATERIALIZED (SELECT deployment, frame, arg_min(prevs, total) AS prevs FROM walk_ WHERE k = n AND skips = 0 GROUP BY 1, 2),
 link_ AS MATERIALIZED (SELECT i.deployment, i.frame, i.cur, i.prev, i.cost FROM best_ b JOIN idx_ i ON i.deployment = b.deployment AND i.frame = b.frame AND b.prevs[i.k] = i.prev)"""


def _frames(t):
    n = t.embeddings.agg(F.count("*")).scalar()
    clipped = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    features = t.embeddings.select("vec_id", clipped.alias("feature"))
    return t.frame_boxes.withColumn("vec_id", F.col("box_id") % n).join(features, "vec_id").drop("vec_id")


@query("cosine_similarity", with_views("frame_boxes") + FEATURES + """
SELECT c.box_id AS cur, p.box_id AS prev, round(list_dot_product(p.feature, c.feature) / (sqrt(list_dot_product(p.feature, p.feature)) * sqrt(list_dot_product(c.feature, c.feature))), 6) AS cosine
FROM f_ c JOIN f_ p ON p.box_id + 4 = c.box_id""")
def cosine_similarity(t):
    moths = _frames(t).filter("class = 'moth'")
    cur = moths.select(F.col("box_id").alias("cur"), F.col("feature").alias("b"))
    prev = moths.select((F.col("box_id") + 4).alias("cur"), F.col("box_id").alias("prev"), F.col("feature").alias("a"))
    return cur.join(prev, "cur").select("cur", "prev", F.round(arrays.cosine_similarity("a", "b"), 6).alias("cosine"))


@query("tracking_cost", FRAMES + "SELECT deployment, frame, cur, prev, round(cost, 6) AS cost FROM cost_")
def tracking_cost(t):
    return tracking.frame_pairs(_frames(t)).withColumn("cost", F.round("cost", 6))


@query("frame_assignment", ASSIGN + "SELECT deployment, frame, cur, prev, round(cost, 6) AS cost FROM link_")
def frame_assignment(t):
    return tracking.frame_assignment(_frames(t)).withColumn("cost", F.round("cost", 6))


@query("track_ids", ASSIGN + """,
 up_ AS (SELECT * FROM link_ WHERE cost < 1.7e0),
 chain_ AS (SELECT deployment, box_id, box_id AS root FROM f_ WHERE box_id NOT IN (SELECT cur FROM up_)
   UNION ALL SELECT c.deployment, u.cur, c.root FROM chain_ c JOIN up_ u ON u.deployment = c.deployment AND u.prev = c.box_id),
 num_ AS (SELECT root, row_number() OVER (PARTITION BY r.deployment ORDER BY f.frame, root) AS track_id FROM (SELECT DISTINCT deployment, root FROM chain_) r JOIN f_ f ON f.box_id = root)
SELECT b.deployment, b.frame, b.box_id, coalesce(CAST(n.track_id AS VARCHAR), 'NA') AS track_id, CAST(b.x1 + floor((b.x2 - b.x1) / 2) AS BIGINT) AS centre_x,
 CAST(b.y1 + floor((b.y2 - b.y1) / 2) AS BIGINT) AS centre_y, CAST(p.x1 + floor((p.x2 - p.x1) / 2) AS BIGINT) AS prev_x, CAST(p.y1 + floor((p.y2 - p.y1) / 2) AS BIGINT) AS prev_y
FROM frame_boxes b LEFT JOIN chain_ c ON c.box_id = b.box_id LEFT JOIN num_ n ON n.root = c.root LEFT JOIN up_ u ON u.cur = b.box_id LEFT JOIN f_ p ON p.box_id = u.prev""")
def track_ids(t):
    boxes = _frames(t)
    links = tracking.frame_assignment(boxes, 1.7)
    out = tracking.export_tracks(tracking.track_ids(boxes, links))
    return out.select("deployment", "frame", "box_id", "track_id", "centre_x", "centre_y", "prev_x", "prev_y")


@query("hard_example_window", with_views("video_predictions") + """,
 w_ AS (SELECT v.video, v.frame, v.class, count(*) AS n, count(DISTINCT o.class) AS kinds, min(o.class) AS other, min(o.confidence) AS low
        FROM video_predictions v JOIN video_predictions o ON o.video = v.video AND o.frame BETWEEN v.frame - 2 AND v.frame + 2 AND o.frame <> v.frame GROUP BY 1, 2, 3)
SELECT video, frame, class, other AS correct_class FROM w_ WHERE n = 4 AND kinds = 1 AND low >= 0.5e0 AND class <> other""")
def hard_example_window(t):
    return tracking.hard_example_window(t.video_predictions, 2, 0.5, tile=100)


@query("cyclic_assignment", """
WITH n_ AS (SELECT count(*) AS n FROM part), p_ AS (SELECT s_suppkey, c.copy, s.slot, s_suppkey * 2 + c.copy AS iter
 FROM supplier, (SELECT unnest(range(0, 2)) AS copy) c, (SELECT unnest(range(0, 7)) AS slot) s)
SELECT s_suppkey, CAST(copy AS INTEGER) AS copy, CAST(slot AS INTEGER) AS slot, iter, (iter * 7 + slot) % n AS crop,
 CAST(CASE WHEN (iter * 7 // n) % 6 < 4 THEN (iter * 7 // n) % 6 ELSE 0 END AS INTEGER) AS rot90, CAST(CASE WHEN (iter * 7 // n) % 6 >= 4 THEN (iter * 7 // n) % 6 - 4 END AS INTEGER) AS flip_axis
FROM p_, n_""")
def cyclic_assignment(t):
    return tracking.cyclic_assignment(t.supplier.select("s_suppkey"), t.part, "s_suppkey", 2, 7)
