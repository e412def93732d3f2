"""Null, tie and empty-group rules on hand-made frames."""

from pyspark.sql import functions as F

from fieldlens.functions import boxes as bx
from fieldlens.functions import names
from fieldlens.operators import checklists, filters, joins, matching, sampling


def test_filters_keep_unknown(spark, rows):
    df = spark.createDataFrame([(1, None, None, 10), (2, "a", 10, 100), (3, "b", 100, None), (4, "b", 100, 63)],
                               "id int, datasetKey string, width int, height int")
    assert rows(filters.ignore_dataset(df, "a"), "id") == [(1,), (3,), (4,)]
    assert rows(filters.remove_thumbnails(df), "id") == [(3,)]


def test_non_adults(spark, rows):
    df = spark.createDataFrame([(1, "Adult", None), (2, None, "Adult"), (3, "Larva", "Adult"), (4, None, None), (5, "Imago", "Larva")],
                               "id int, lifeStage string, life_stage_prediction string")
    assert rows(filters.remove_non_adults(df), "id") == [(1,), (2,), (3,), (5,)]


def test_duplicates_treat_nulls_as_equal(spark, rows):
    df = spark.createDataFrame([(1, "u"), (2, None), (3, None), (4, "v"), (5, "u")], "id int, identifier string")
    assert rows(filters.drop_all_duplicates(df), "id") == [(4,)]
    one = df.filter("id in (2, 4)")
    assert rows(filters.drop_all_duplicates(one), "id") == [(2,), (4,)]


def test_funnel_counts_and_rows_agree(spark):
    df = spark.createDataFrame(
        [(i, f"u{i if i > 2 else 1}", "d", 100 if i % 3 else 10, 100, "Adult" if i % 4 else None, None) for i in range(12)],
        "id int, identifier string, datasetKey string, width int, height int, lifeStage string, life_stage_prediction string")
    clean, report = filters.clean_funnel(df, ignored="x")
    counts = {r["rule"]: r["images"] for r in report.collect()}
    assert sum(counts.values()) == 12 and counts["kept"] == clean.count() and counts["duplicate_url"] == 3


def test_paths(spark):
    r = spark.createDataFrame([(None, 7, 0), ("d", 7, 2)], "datasetKey string, coreid long, cnt long")
    assert [x[0] for x in r.select(names.image_path()).collect()] == ["nan/7.jpg", "d/7_2.jpg"]
    s = spark.createDataFrame([("a.B/C.d.JPG",), ("x/.hidden",), ("plain",)], "image_path string")
    assert [x[0] for x in s.select(names.sample_key()).collect()] == ["a_b/c_d", "x/_hidden", "plain"]


def test_class_zero_is_a_class(spark, rows):
    df = spark.createDataFrame([(1, 10), (2, 2), (3, None)], "id int, k long")
    ids = checklists.category_map(df, "k")
    assert rows(ids, "category", "class_id") == [("10", 1), ("2", 0)]
    matched, unmatched = joins.category_id_join(df, ids, "k")
    assert rows(matched, "id", "class_id") == [(1, 1), (2, 0)] and rows(unmatched, "k", "rows") == [(None, 1)]


def test_best_detection_ties(spark, rows):
    df = spark.createDataFrame([("i", 0, 0.5), ("i", 1, 0.9), ("i", 2, 0.9), ("j", 0, 0.0)], "image string, pos int, conf double")
    df = df.select("*", *[F.lit(0.1).alias(c) for c in ("x", "y", "width", "height")])
    assert rows(matching.best_detection(df), "image", "pos") == [("i", 1)]


def test_iou_variants(spark):
    r = spark.createDataFrame([(0, 0, 9, 9, 5, 0, 14, 9)], "a_x1 int,a_y1 int,a_x2 int,a_y2 int,b_x1 int,b_y1 int,b_x2 int,b_y2 int")
    got = r.select(bx.iou(), bx.iou(inclusive=True)).first()
    assert abs(got[0] - 36 / 126) < 1e-12 and got[1] == 0.33


def test_square_crop_is_clipped(spark):
    r = spark.range(1).select(*bx.square_crop_box(F.lit(0.0), F.lit(0.1), F.lit(0.5), F.lit(0.2), F.lit(100), F.lit(50))).first()
    assert tuple(r) == (0, 0, 55, 40)


def test_column_zip_rejects_uneven(spark):
    import pytest

    a = spark.createDataFrame([(1, "x"), (2, "y")], "p long, a string")
    b = spark.createDataFrame([(1, "u")], "q long, b string")
    with pytest.raises(Exception, match="differ in length"):
        joins.column_zip(a, b, "p", "q").collect()


def test_group_cap_drops_null_keys(spark):
    df = spark.createDataFrame([(f"i{n}", n % 3 if n < 9 else None) for n in range(12)], "image_path string, k long")
    out = sampling.group_cap(df, "k", 2)
    assert sorted(r[0] for r in out.groupBy("k").count().select("count").collect()) == [2, 2, 2]


def test_backbone_two_edits(spark):
    asked = spark.createDataFrame([("abcdef gh",), ("abxdxf gh",), ("zzz",)], "search_species string")
    known = spark.createDataFrame([("abcdef gh", 5, None, "fam", "abcdef", "ACCEPTED", "SPECIES")],
                                  "name string, usage_key long, accepted_usage_key long, family string, genus string, status string, rank string")
    got = {r["search_species"]: r["match_type"] for r in checklists.backbone_match(asked, known, "s", max_edits=2).collect()}
    assert got == {"abcdef gh": "EXACT", "abxdxf gh": "FUZZY", "zzz": "NONE"}


def test_funnel_and_duplicates_read_their_rows_once(spark, tmp_path):
    # a null URL is a value, rows that another rule removes are counted under it
    data = [(1, "a", "d", 100, "Adult"), (2, "a", "d", 100, "Adult"), (3, None, "d", 100, "Adult"), (4, "b", "x", 100, "Adult"),
            (5, "c", "d", 1, "Adult"), (6, "e", None, None, None), (7, "f", None, None, "Imago")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(data, "id int, identifier string, datasetKey string, width int, lifeStage string").write.parquet(path)
    df = spark.read.parquet(path).withColumn("height", F.lit(90)).withColumn("life_stage_prediction", F.lit(None).cast("string"))
    clean, report = filters.clean_funnel(df, ignored="x")
    assert sorted(map(tuple, clean.collect()), key=repr) == [(3, None, "d", 100, "Adult", 90, None), (7, "f", None, None, "Imago", 90, None)]
    assert clean.columns == df.columns
    assert {tuple(r) for r in report.collect()} == {(1, "duplicate_url", 2), (2, "dataset", 1), (3, "thumbnail", 1), (4, "non_adult", 1), (5, "kept", 2)}
    alone = filters.drop_all_duplicates(df.select("id", "identifier"))
    assert sorted(r.id for r in alone.collect()) == [3, 4, 5, 6, 7]
    for one in (clean, report, alone):
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Join" not in plan


def test_first_rows_keep_ties_and_need_no_shuffle_where_occurrences_lie_together(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (None, "z", 4), (None, "y", 5), (2, None, 6), (3, None, 7), (3, "c", 8)],
                               "coreid long, ord string, id int")
    assert sorted(r.id for r in joins.first_per_occurrence(df, "ord").collect()) == [2, 3, 5, 8]
    first = joins.first_per_occurrence(df.repartition(3, "coreid"), "ord")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
