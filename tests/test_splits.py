"""Split properties: no leak, whole input, quotas, caps and floor."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldlens.operators import sampling, selection
from fieldlens.plans.commands import split_dataset


@pytest.fixture(scope="module")
def metadata(spark):
    data = []
    for occ in range(700):
        key = None if occ % 50 == 0 else (1 if occ % 3 else occ % 23)
        data += [(f"p{occ}_{i}", occ, key, f"{occ:05d}{i}") for i in range(1 + occ % 3)]
    return spark.createDataFrame(data, "image_path string, coreid long, acceptedTaxonKey long, ord string").persist()


def test_stratified_split(metadata):
    out = sampling.stratified_split(metadata, row_order="ord").persist()
    assert out.count() == metadata.count()
    assert out.groupBy("coreid").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    assert out.filter("acceptedTaxonKey is null and split <> 'train'").isEmpty()
    units = out.select("coreid", "acceptedTaxonKey", "split").distinct()
    sizes = {r[0]: r[1] for r in units.dropna().groupBy("acceptedTaxonKey").count().collect()}
    tests = {r[0]: r[1] for r in units.filter("split = 'test'").groupBy("acceptedTaxonKey").count().collect()}
    eligible = {k: n for k, n in sizes.items() if n >= 5}
    assert set(tests) <= set(eligible)
    assert sum(tests.values()) == math.ceil(0.2 * sum(eligible.values()))
    wanted = math.ceil(0.2 * sum(eligible.values()))
    for k, n in eligible.items():
        share = wanted * n / sum(eligible.values())
        assert math.floor(share) <= tests.get(k, 0) <= math.floor(share) + 1


def test_caps_and_floor(metadata):
    out = split_dataset(metadata, max_instances=40, min_instances=10, row_order="ord")
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("split", "acceptedTaxonKey").count().collect()}
    limit = {"train": 40, "val": 4, "test": 8}
    assert counts and all(n <= limit[s] for (s, _), n in counts.items())
    assert all(counts.get(("train", k), 0) >= 10 for _, k in counts)
    loose = split_dataset(metadata, max_instances=40, min_instances=0, row_order="ord")
    assert loose.filter("acceptedTaxonKey is null").count() == metadata.filter("acceptedTaxonKey is null").count()


def test_ratio_and_pair_split(metadata):
    out = sampling.ratio_split(metadata, "acceptedTaxonKey")
    n = metadata.filter("acceptedTaxonKey = 1").count()
    got = {r[0]: r[1] for r in out.filter("acceptedTaxonKey = 1").groupBy("split").count().collect()}
    assert got == {"train": int(n * 0.7), "test": int(n * 0.2), "val": n - int(n * 0.7) - int(n * 0.2)}
    pairs = sampling.random_pair_split(metadata, "image_path")
    assert pairs.filter("split = 'train'").count() == int(0.8 * metadata.count())
    with pytest.raises(ValueError):
        sampling.ratio_split(metadata, "acceptedTaxonKey", train=0.9)


def _names(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i long").repartition(5)


@pytest.mark.parametrize("listed", [3, 10_000])
def test_cuts_equal_those_of_the_sorted_list(spark, monkeypatch, listed):
    monkeypatch.setattr(selection, "LISTED", listed)
    rnd = random.Random(listed)
    pools = [
        [f"ds{rnd.randint(0, 3)}/{rnd.randint(0, 10**6)}_{rnd.randint(0, 3)}.jpg" for _ in range(700)], ["é" * k + "z" for k in range(60)] + [None, None, ""],
        ["same"] * 50 + ["a"] * 3 + ["t", "sam", "samee"], ["one"], [],
    ]
    key = lambda n: (n is not None, (n or "").encode())
    for names in pools:
        df = _names(spark, names)
        ordered = sorted(names, key=key)
        halves = sampling.half_split(df, "name").collect()
        assert sorted((r["name"] for r in halves if r["half"] == 1), key=key) == ordered[: len(names) // 2] and len(halves) == len(names)
        every = sampling.systematic_sample(df, "name", 3).collect()
        assert sorted((r["name"] for r in every), key=key) == ordered[::3]
        drawn = sampling.random_pair_split(df, "name", 80).collect()
        assert sum(r["split"] == "train" for r in drawn) == int(0.8 * len(names)) and len(drawn) == len(names)


def test_large_bins_are_cut(spark, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 16)
    names = [f"http://img.example/traps/{i:06d}" for i in range(500)] + ["http://img.example/traps/000007"] * 200
    df = _names(spark, names)
    sizes = {bytes(r["b"]): r["count"] for r in df.groupBy(selection.name_bins(df, F.col("name")).alias("b")).count().collect()}
    assert sorted(sizes.values())[-2] <= 700 // 16 and max(sizes.values()) == 201
    ranks = sorted((r["r"], r["name"]) for r in selection.name_rank(df, F.col("name"), "r").collect())
    assert [r for r, _ in ranks] == list(range(1, 701)) and [n for _, n in ranks] == sorted(names)
