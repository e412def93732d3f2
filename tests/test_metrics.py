"""Metrics and calibration against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import arrays
from fieldlens.functions.arrays import ClassTaxonomy
from fieldlens.operators import calibration, evaluate


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(200, 6)) * 3
    y = rng.integers(0, 6, 200)
    z[np.arange(200), y] += np.where(np.arange(200) % 3, 4.0, 0.0)
    df = spark.createDataFrame([(i, z[i].tolist(), int(y[i])) for i in range(200)], "vec_id long, logits array<double>, label int")
    taxa = spark.createDataFrame([(i, f"s{i}", f"g{i % 3}", f"f{i % 2}") for i in range(6)], "class_id int, species string, genus string, family string")
    return z, y, df.persist(), ClassTaxonomy(taxa)


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_softmax_and_mask(scored):
    z, _, df, _ = scored
    got = np.array([r[0] for r in df.orderBy("vec_id").select(arrays.softmax("logits")).collect()])
    assert np.allclose(got, _softmax(z)) and np.allclose(got.sum(axis=1), 1)
    keep = [0, 4]
    a = np.array([r[0] for r in df.orderBy("vec_id").select(arrays.softmax(arrays.class_mask("logits", keep))).collect()])
    assert np.all(a[:, [1, 2, 3, 5]] == 0) and np.allclose(a.sum(axis=1), 1)
    assert np.allclose(a[:, keep], _softmax(z[:, keep]))


def test_rollup(scored):
    z, _, df, taxa = scored
    p = _softmax(z)
    rows = df.orderBy("vec_id").select(arrays.taxon_rollup(arrays.softmax("logits"), taxa, "GENUS")).collect()
    for i, r in enumerate(rows):
        sums = {f"g{g}": round(float(np.round(p[i, g::3], 3).sum()), 3) for g in range(3)}
        got = [(x["name"], x["conf"]) for x in r[0]]
        assert dict(got) == pytest.approx(sums) and [c for _, c in got] == sorted((c for _, c in got), reverse=True)


def test_rollup_tie_goes_to_the_more_confident_class(spark, scored):
    taxa = scored[3]
    probs = F.array(*[F.lit(x) for x in (0.1, 0.3, 0.1, 0.1, 0.0, 0.4)])
    first = spark.range(1).select(arrays.taxon_rollup(probs, taxa, "GENUS")[0]["name"], arrays.top_k(probs, 2)["i"]).first()
    assert first[0] == "g2" and list(first[1]) == [5, 1]


def test_micro_macro_and_thresholds(scored):
    z, y, df, taxa = scored
    table = evaluate.evaluation_table(df, taxa).persist()
    micro = {r["level"]: r for r in evaluate.topk_micro_accuracy(table).collect()}
    hits = (_softmax(z).argmax(axis=1) == y)
    assert micro["SPECIES"]["top1"] == round(hits.mean() * 100, 2) and micro["SPECIES"]["top10"] == 100.0
    macro = {r["level"]: r for r in evaluate.macro_accuracy(table).collect()}
    want = np.mean([hits[y == c].mean() for c in np.unique(y)]) * 100
    assert macro["SPECIES"]["macro_top1"] == pytest.approx(want, abs=0.006)
    for r in evaluate.accuracy_vs_confidence(table).collect():
        assert r["conf_total"] + r["reject"] == r["moths_total"] == 200 and r["correct"] <= r["conf_total"]


def test_temperature(scored):
    z, y, df, _ = scored
    t = calibration.tune_temperature(df)

    def nll(temp):
        return -np.log(_softmax(z / temp)[np.arange(200), y]).mean()

    assert nll(t) <= min(nll(1.0), nll(t - 0.01), nll(t + 0.01))
    report = calibration.calibration_report(df, t).first()
    assert report["nll_after"] == pytest.approx(nll(t), abs=1e-6) and report["nll_before"] == pytest.approx(nll(1.0), abs=1e-6)


def test_temperature_without_an_optimum_raises(spark):
    schema = "logits array<double>, label int"
    always_right = spark.createDataFrame([([3.0, 0.0], 0), ([0.0, 2.0], 1)], schema)
    always_wrong = spark.createDataFrame([([3.0, 0.0], 1), ([0.0, 2.0], 0)], schema)
    for df in (always_right, always_wrong):
        with pytest.raises(ArithmeticError):
            calibration.tune_temperature(df, max_steps=6)
    with pytest.raises(ValueError):
        calibration.tune_temperature(always_right.limit(0))


def test_binary_metrics_without_positives(spark):
    df = spark.createDataFrame([("Non-Moth", "Non-Moth", 50)], "gt string, pred string, conf int")
    r = evaluate.binary_metrics(df).first()
    assert r["accuracy"] == 100.0 and r["precision"] is None and r["f1"] is None


def test_long_tail_buckets_and_bins(spark):
    counts = [0, 4, 5, 9, 10, 19, 20, 50, 100, 101, 200, 500, 1000, 1001]
    classes = spark.createDataFrame([(f"c{n}", 1, 4) for n in counts], "gt string, correct long, total long")
    train = spark.createDataFrame([(f"c{n}", n) for n in counts], "gt string, n_train long")
    tail = {r["bucket"]: (r["classes"], r["accuracy"]) for r in evaluate.long_tail_accuracy(classes, train).collect()}
    assert tail == {"few": (6, 25.0), "medium": (3, 25.0), "many": (5, 25.0)}
    bins = {r["bin"]: r["classes"] for r in evaluate.binned_accuracy_boxplot(classes, train).collect()}
    assert bins == {"0-4": 2, "5-9": 2, "10-19": 2, "20-49": 1, "50-99": 1, "100-199": 2, "200-499": 1, "500-1K": 2, "1K+": 1}
