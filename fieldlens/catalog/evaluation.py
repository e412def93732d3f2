"""Prediction-vector, metric and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.catalog import query
from fieldlens.functions import arrays, names
from fieldlens.functions.arrays import ClassTaxonomy
from fieldlens.operators import calibration, evaluate, scoring
from fieldlens.plans.fixtures import with_views

PROBS = with_views("probs")
RANKED = with_views("ranked_predictions")
EVAL = RANKED + """,
 table_ AS MATERIALIZED (SELECT vec_id, level, gt, max(CASE WHEN rk = 1 THEN pred END) AS pred, max(CASE WHEN rk = 1 THEN conf END) AS conf,
                  coalesce(max(CASE WHEN pred = gt THEN rk END), 0) AS gt_rank FROM ranked_predictions GROUP BY vec_id, level, gt)"""
CROPS = with_views("crop_labels", "images", "taxonomy") + """,
 p_ AS MATERIALIZED (SELECT label AS gt, CASE WHEN crop_id % 4 = 0 THEN 'species 0' WHEN crop_id % 7 = 0 AND acceptedTaxonKey % 3 = 0 THEN concat('syn ', label) ELSE label END AS pred
        FROM crop_labels WHERE taxon_rank = 'SPECIES'),
 n_ AS (SELECT x.species AS gt, count(i.acceptedTaxonKey) AS n_train FROM taxonomy x LEFT JOIN images i ON i.acceptedTaxonKey = x.speciesKey GROUP BY 1),
 a_ AS (SELECT gt, count(CASE WHEN gt = pred THEN 1 END) AS correct, count(*) AS total FROM p_ GROUP BY gt),
 j_ AS (SELECT a_.*, n_.n_train, round(correct / total * 100, 2) AS acc FROM a_ JOIN n_ ON n_.gt = a_.gt)"""


def _table(t):
    return evaluate.evaluation_table(t.logits, ClassTaxonomy(t.class_taxonomy))


def _crop_preds(t):
    pred = (
        F.when(F.col("crop_id") % 4 == 0, "species 0")
        .when((F.col("crop_id") % 7 == 0) & (F.col("acceptedTaxonKey") % 3 == 0), F.concat(F.lit("syn "), F.col("label")))
        .otherwise(F.col("label"))
    )
    return t.crop_labels.filter("taxon_rank = 'SPECIES'").select(F.col("label").alias("gt"), pred.alias("pred"))


def _train_counts(t):
    per_key = t.images.groupBy(F.col("acceptedTaxonKey").alias("speciesKey")).agg(F.count("*").alias("n"))
    return t.taxonomy.join(per_key, "speciesKey", "left").select(F.col("species").alias("gt"), F.coalesce("n", F.lit(0)).alias("n_train"))


def _flat(df, column, out="p"):
    """Vectors as rows, rounded, so that both engines compare them as plain numbers."""
    return df.select("vec_id", F.posexplode(column).alias("i", "v")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias(out))


@query("softmax", PROBS + "SELECT vec_id, u - 1 AS i, round(probs[u], 6) AS p FROM (SELECT *, unnest(range(1, len(probs) + 1)) AS u FROM probs) q")
def softmax(t):
    return _flat(t.logits.select("vec_id", arrays.softmax("logits").alias("probs")), "probs")


@query("class_mask", with_views("logits") + """,
 m_ AS (SELECT vec_id, list_transform(logits, lambda z, i: CASE WHEN (i - 1) % 3 <> 1 THEN z ELSE '-inf'::DOUBLE END) AS z FROM logits),
 e_ AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM m_)
SELECT vec_id, u - 1 AS i, round(e[u] / list_sum(e), 6) AS p FROM (SELECT *, unnest(range(1, len(e) + 1)) AS u FROM e_) q""")
def class_mask(t):
    masked = arrays.class_mask("logits", [i for i in range(ClassTaxonomy(t.class_taxonomy).width) if i % 3 != 1])
    return _flat(t.logits.select("vec_id", arrays.softmax(masked).alias("probs")), "probs")


@query("temperature_scale", with_views("logits") + "SELECT vec_id, u - 1 AS i, round(logits[u] / 0.9208e0, 6) AS z FROM (SELECT *, unnest(range(1, len(logits) + 1)) AS u FROM logits) q")
def temperature_scale(t):
    return _flat(t.logits.select("vec_id", arrays.temperature_scale("logits", 0.9208).alias("z")), "z", "z")


@query("merge_to_binary_probs", PROBS + "SELECT vec_id, round(probs[1], 6) AS p0, round(list_sum(probs[2:]), 6) AS p1 FROM probs")
def merge_to_binary_probs(t):
    b = arrays.merge_to_binary_probs(arrays.softmax("logits"))
    return t.logits.select("vec_id", b.alias("b")).select("vec_id", F.round(F.col("b")[0], 6).alias("p0"), F.round(F.col("b")[1], 6).alias("p1"))


@query("topk_predictions", with_views("evaluated", "class_taxonomy") + """
SELECT e.vec_id, e.pos AS rank, t.species AS name, round(e.p * 100, 2) AS conf FROM evaluated e JOIN class_taxonomy t ON t.class_id = e.class_id WHERE pos <= 5""")
def topk_predictions(t):
    names_ = ClassTaxonomy(t.class_taxonomy).name_array("SPECIES")
    top = t.logits.select("vec_id", F.posexplode(arrays.topk_predictions(arrays.softmax("logits"), names_, 5)).alias("i", "t"))
    return top.select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), "t.name", "t.conf")


@query("taxon_rollup", RANKED + "SELECT vec_id, level, rk AS rank, pred AS name, conf FROM ranked_predictions WHERE level <> 'SPECIES'")
def taxon_rollup(t):
    tax = ClassTaxonomy(t.class_taxonomy)
    levels = F.array(*[
        F.struct(F.lit(lv).alias("level"), arrays.taxon_rollup("probs", tax, lv).alias("r")) for lv in ("GENUS", "FAMILY")])
    probs = t.logits.select("vec_id", arrays.softmax("logits").alias("probs"))
    rows = probs.select("vec_id", F.explode(levels).alias("l")).select("vec_id", "l.level", F.posexplode("l.r").alias("i", "t"))
    return rows.select("vec_id", "level", (F.col("i") + 1).cast("long").alias("rank"), "t.name", "t.conf")


@query("topk_micro_accuracy", EVAL + """
SELECT level, count(*) AS total, round(avg(CASE WHEN gt_rank BETWEEN 1 AND 1 THEN 1 ELSE 0 END) * 100, 2) AS top1,
 round(avg(CASE WHEN gt_rank BETWEEN 1 AND 3 THEN 1 ELSE 0 END) * 100, 2) AS top3, round(avg(CASE WHEN gt_rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END) * 100, 2) AS top5,
 round(avg(CASE WHEN gt_rank BETWEEN 1 AND 10 THEN 1 ELSE 0 END) * 100, 2) AS top10 FROM table_ GROUP BY level""")
def topk_micro_accuracy(t):
    return evaluate.topk_micro_accuracy(_table(t))


MACRO = """,
 c_ AS (SELECT level, gt, count(*) AS total, sum(CASE WHEN gt_rank = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN gt_rank BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS c5
        FROM table_ GROUP BY level, gt)"""


@query("macro_accuracy", EVAL + MACRO + """
SELECT level, count(*) AS classes, round(avg(c1 / total * 100), 2) AS macro_top1, round(avg(c5 / total * 100), 2) AS macro_top5 FROM c_ GROUP BY level""")
def macro_accuracy(t):
    return evaluate.macro_accuracy(_table(t))


@query("macro_accuracy_rounded", EVAL + MACRO + """
SELECT level, count(*) AS classes, round(sum(CAST(round(round(c1 / total * 100, 2) * 100) AS BIGINT)) / count(*)) / 100 AS macro_top1,
 round(sum(CAST(round(round(c5 / total * 100, 2) * 100) AS BIGINT)) / count(*)) / 100 AS macro_top5 FROM c_ GROUP BY level""")
def macro_accuracy_rounded(t):
    return evaluate.macro_accuracy(_table(t), round_per_class=True)


@query("per_class_accuracy", CROPS + """
SELECT gt, count(CASE WHEN gt = pred OR pred = concat('syn ', gt) THEN 1 END) AS correct, count(*) AS total,
 round(count(CASE WHEN gt = pred OR pred = concat('syn ', gt) THEN 1 END) / count(*) * 100, 2) AS accuracy FROM p_ GROUP BY gt""")
def per_class_accuracy(t):
    synonyms = t.taxonomy.select(F.concat(F.lit("syn "), F.col("species")).alias("pred"), F.col("species").alias("synonym"))
    more = t.crop_labels.filter("taxon_rank = 'SPECIES'").select(F.concat(F.lit("syn "), F.col("label")), "label")
    return evaluate.per_class_accuracy(_crop_preds(t), synonyms.union(more).distinct())


@query("long_tail_accuracy", CROPS + """
SELECT CASE WHEN n_train < 20 THEN 'few' WHEN n_train <= 100 THEN 'medium' ELSE 'many' END AS bucket, count(*) AS classes, round(sum(CAST(round(acc * 100) AS BIGINT)) / count(*)) / 100 AS accuracy FROM j_ GROUP BY 1""")
def long_tail_accuracy(t):
    return evaluate.long_tail_accuracy(evaluate.per_class_accuracy(_crop_preds(t)), _train_counts(t))


@query("binned_accuracy_boxplot", CROPS + """
SELECT CASE WHEN n_train < 5 THEN '0-4' WHEN n_train < 10 THEN '5-9' WHEN n_train < 20 THEN '10-19' WHEN n_train < 50 THEN '20-49' WHEN n_train < 100 THEN '50-99'
 WHEN n_train < 200 THEN '100-199' WHEN n_train < 500 THEN '200-499' WHEN n_train <= 1000 THEN '500-1K' ELSE '1K+' END AS bin, count(*) AS classes,
 round(min(acc), 4) AS "min", round(quantile_cont(acc, 0.25), 4) AS q1, round(quantile_cont(acc, 0.5), 4) AS "median", round(quantile_cont(acc, 0.75), 4) AS q3,
 round(max(acc), 4) AS "max" FROM j_ GROUP BY 1""")
def binned_accuracy_boxplot(t):
    return evaluate.binned_accuracy_boxplot(evaluate.per_class_accuracy(_crop_preds(t)), _train_counts(t))


@query("binary_metrics", with_views("binary_predictions") + """,
 c_ AS (SELECT count(CASE WHEN gt = 'Moth' AND pred = 'Moth' THEN 1 END) AS tp, count(CASE WHEN gt <> 'Moth' AND pred <> 'Moth' THEN 1 END) AS tn,
        count(CASE WHEN gt <> 'Moth' AND pred = 'Moth' THEN 1 END) AS fp, count(CASE WHEN gt = 'Moth' AND pred <> 'Moth' THEN 1 END) AS fn FROM binary_predictions),
 s_ AS (SELECT *, tp + tn + fp + fn AS total, round((tp + fn) / (tp + tn + fp + fn) * 100, 2) AS moth_share, round((tn + fp) / (tp + tn + fp + fn) * 100, 2) AS nonmoth_share,
        round((tp + tn) / (tp + tn + fp + fn) * 100, 2) AS accuracy, round(tp / (tp + fp) * 100, 2) AS precision, round(tp / (tp + fn) * 100, 2) AS recall FROM c_)
SELECT *, round(2 * precision * recall / (precision + recall), 2) AS f1 FROM s_""")
def binary_metrics(t):
    return evaluate.binary_metrics(t.binary_predictions)


@query("binary_label", with_views("annotation_items") + """
SELECT conv_id, pos, label, CASE WHEN label IN ('Unidentifiable', 'Unclassified') THEN NULL WHEN label = 'Non-Moth' THEN 'Non-Moth' WHEN label IS NOT NULL THEN 'Moth' END AS gt,
 CASE WHEN split_part(path_a, '/', 1) = 'Lepidoptera' AND pos % 2 = 0 THEN 'Moth' ELSE 'Non-Moth' END AS pred FROM annotation_items""")
def binary_label(t):
    order = F.when(F.col("pos") % 2 == 0, F.substring_index("path_a", "/", 1)).otherwise("Diptera")
    return t.annotation_items.select("conv_id", "pos", "label", names.binary_label("label").alias("gt"), names.binary_prediction(order).alias("pred"))


@query("confidence_histogram", with_views("binary_predictions") + """
SELECT CASE WHEN gt = 'Moth' AND pred = 'Moth' THEN 'TP' WHEN gt = 'Moth' THEN 'FN' WHEN pred = 'Moth' THEN 'FP' ELSE 'TN' END AS outcome,
 least(conf // 10, 9) * 10 AS bin, count(*) AS n FROM binary_predictions GROUP BY 1, 2""")
def confidence_histogram(t):
    return evaluate.confidence_histogram(t.binary_predictions)


@query("accuracy_vs_confidence", EVAL + """
SELECT level, CAST(th AS INTEGER) AS threshold, count(CASE WHEN floor(conf * 100) > th AND gt = pred THEN 1 END) AS correct,
 count(CASE WHEN floor(conf * 100) > th THEN 1 END) AS conf_total, count(CASE WHEN floor(conf * 100) <= th THEN 1 END) AS reject, count(*) AS moths_total,
 CASE WHEN count(CASE WHEN floor(conf * 100) > th THEN 1 END) > 0 THEN
   round(count(CASE WHEN floor(conf * 100) > th AND gt = pred THEN 1 END) / count(CASE WHEN floor(conf * 100) > th THEN 1 END) * 100, 2) END AS accuracy,
 round(count(CASE WHEN floor(conf * 100) <= th THEN 1 END) / count(*) * 100, 2) AS rejection
FROM table_, (SELECT unnest(range(10, 100, 10)) AS th) h GROUP BY level, th""")
def accuracy_vs_confidence(t):
    return evaluate.accuracy_vs_confidence(_table(t))


@query("confusion_matrix", EVAL + "SELECT level, gt, pred, count(*) AS n FROM table_ GROUP BY level, gt, pred")
def confusion_matrix(t):
    return evaluate.confusion_matrix(_table(t))


BINS = """,
 s_ AS (SELECT label, list_max(probs) AS conf, list_position(probs, list_max(probs)) - 1 AS pred FROM probs),
 b_ AS (SELECT CAST(ceil(conf * 10) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS avg_conf, avg(CASE WHEN pred = label THEN 1 ELSE 0 END) AS accuracy,
        count(*) / (SELECT count(*) FROM s_) AS share FROM s_ WHERE conf > 0 GROUP BY 1)"""


@query("expected_calibration_error", PROBS + BINS + "SELECT round(sum(share * abs(avg_conf - accuracy)), 3) AS ece FROM b_")
def expected_calibration_error(t):
    return calibration.expected_calibration_error(t.logits)


@query("reliability_rows", PROBS + BINS + "SELECT bin, n, round(avg_conf, 6) AS avg_conf, round(accuracy, 6) AS accuracy, round(share, 6) AS share FROM b_")
def reliability_rows(t):
    r = calibration.reliability_rows(t.logits)
    return r.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("avg_conf", "accuracy", "share")])


@query("cross_entropy_metrics", PROBS + """,
 r_ AS (SELECT -ln(p.probs[p.label + 1]) AS o, -ln(CASE WHEN p.label = 0 THEN p.probs[1] ELSE list_sum(p.probs[2:]) END) AS b,
        list_sum(list_transform(p.probs, lambda v: -ln(v))) / len(p.probs) AS u FROM probs p)
SELECT round(avg(o), 6) AS order_loss, round(avg(b), 6) AS binary_loss, round(0.5e0 * avg(o) + 0.5e0 * avg(b), 6) AS weighted_loss,
 round(0.9e0 * avg(o) + 0.1e0 * avg(u), 6) AS smoothed_loss FROM r_""")
def cross_entropy_metrics(t):
    return evaluate.cross_entropy_metrics(t.logits)


@query("tune_temperature", with_views("logits", "probs", recursive=True) + """,
 newton_ AS (SELECT 0 AS step, 1 / 1.5e0 AS beta UNION ALL
   SELECT step + 1, any_value(beta) - avg(m - zy) / avg(s - m * m) FROM (
     SELECT q.step, q.beta, q.zy, list_sum(list_transform(q.e, lambda w, i: w * q.logits[i])) / list_sum(q.e) AS m,
            list_sum(list_transform(q.e, lambda w, i: w * q.logits[i] * q.logits[i])) / list_sum(q.e) AS s
     FROM (SELECT n.step, n.beta, l.logits, l.logits[l.label + 1] AS zy, list_transform(l.logits, lambda z: exp((z - list_max(l.logits)) * n.beta)) AS e
           FROM newton_ n, logits l WHERE n.step < 12) q) r GROUP BY step),
 t_ AS (SELECT round(1 / beta, 4) AS t FROM newton_ WHERE step = 12),
 l_ AS (SELECT t_.t, -ln(p.probs[p.label + 1]) AS before_, label, list_transform(l.logits, lambda z: exp((z - list_max(l.logits)) / t_.t)) AS e
        FROM logits l JOIN probs p USING (vec_id, label), t_),
 q_ AS (SELECT t, label, before_, list_transform(e, lambda w: w / list_sum(e)) AS probs FROM l_)""" + """
SELECT any_value(t) AS temperature, round(avg(before_), 6) AS nll_before, round(avg(-ln(probs[label + 1])), 6) AS nll_after,
 (SELECT round(sum(n / tot * abs(c - a)), 3) FROM (SELECT ceil(list_max(probs) * 10) AS b, count(*) AS n, avg(list_max(probs)) AS c,
   avg(CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1 ELSE 0 END) AS a, (SELECT count(*) FROM probs) AS tot FROM probs GROUP BY 1) x) AS ece_before,
 (SELECT round(sum(n / tot * abs(c - a)), 3) FROM (SELECT ceil(list_max(probs) * 10) AS b, count(*) AS n, avg(list_max(probs)) AS c,
   avg(CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1 ELSE 0 END) AS a, (SELECT count(*) FROM q_) AS tot FROM q_ GROUP BY 1) x) AS ece_after
FROM q_""")
def tune_temperature(t):
    return calibration.calibration_report(t.logits, calibration.tune_temperature(t.logits))


@query("batch_score", """
WITH known_ AS MATERIALIZED (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) q
   GROUP BY label, i),
 new_ AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
 d_ AS (SELECT n.vec_id, k.label, sum(n.v * k.m) - 0.5e0 * sum(k.m * k.m) AS s FROM new_ n JOIN known_ k ON k.i = n.i GROUP BY n.vec_id, k.label),
 b_ AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM d_)
SELECT e.vec_id, CASE WHEN e.label = 0 THEN 'earlier' ELSE CAST(b_.label AS VARCHAR) END AS prediction FROM b_ JOIN embeddings e ON e.vec_id = b_.vec_id WHERE r = 1""")
def batch_score(t):
    head = scoring.LinearHead.from_centroids(t.embeddings, "embedding", "label")
    earlier = t.embeddings.filter("label = 0").select("vec_id", F.lit("earlier").alias("prediction"))
    return scoring.append_scores(earlier, scoring.batch_score(t.embeddings, head, "vec_id", "embedding"), "vec_id")
