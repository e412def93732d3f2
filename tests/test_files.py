"""Real files: archive to shards end to end, resumable jobs, incremental verification."""

import os
import tarfile

import pytest
from pyspark.sql import functions as F

from fieldlens.catalog.sources import bmp_bytes
from fieldlens.operators import matching
from fieldlens.operators.scoring import LinearHead
from fieldlens.plans import commands
from fieldlens.sources import documents, images, jobs, shards, tables
from fieldlens.streaming.verify import incremental_verify


@pytest.fixture()
def archive(spark, tmp_path):
    """40 occurrences, two images each; the web is a folder of bitmaps."""
    web = tmp_path / "web"
    web.mkdir()
    media, occ = ["coreid\trights\tidentifier"], ["id\tdatasetKey\tspeciesKey\tfamilyKey\torderKey\tacceptedTaxonKey\tlifeStage\tdecimalLatitude\tdecimalLongitude\teventDate"]
    for i in range(40):
        key = "" if i == 39 else "d1"
        occ.append(f"{i}\t{key}\t{i % 2}\t1\t1\t{i % 2}\t{'Adult' if i % 4 else ''}\t1.5\tx\t2020-01-02")
        for j in range(2):
            (web / f"{i}_{j}.bmp").write_bytes(bmp_bytes(70 + j, 80) if i != 5 else b"broken")
            media.append(f"{i}\tcc\tfile://{web}/{i}_{j}.bmp")
    media += ["bad\tline\twith\tmore\tfields", f"0\tcc\tfile://{web}/gone.bmp"]
    (tmp_path / "multimedia.txt").write_text("\n".join(media) + "\n")
    (tmp_path / "occurrence.txt").write_text("\n".join(occ) + "\n")
    return tmp_path


def test_archive_to_shards(spark, archive):
    meta = commands.load_archive(spark, str(archive / "multimedia.txt"), str(archive / "occurrence.txt"))
    assert meta.count() == 81
    paths = [r[0] for r in meta.filter("coreid = 0").orderBy("cnt").select("image_path").collect()]
    assert paths == ["d1/0.jpg", "d1/0_1.jpg", "d1/0_2.jpg"]
    assert meta.filter("decimalLongitude is null").count() == 81

    data = str(archive / "data")
    status = {r[0]: r[1] for r in commands.fetch_images(meta, data).groupBy("status").count().collect()}
    assert status == {"fetched": 80, "error: URLError": 1}
    again = {r[0]: r[1] for r in commands.fetch_images(meta, data).groupBy("status").count().collect()}
    assert again == {"present": 80, "error: URLError": 1}

    verified, errors = commands.verify_images(meta, data)
    assert verified.count() == 76 and sorted(r[0] for r in errors.collect()) == ["d1/5.jpg", "d1/5_1.jpg"]
    half = verified.filter("cnt = 0").select("image_path", "width", "height", "fetch_date", "file_size", "corrupted")
    resumed, _ = commands.verify_images(meta, data, resume_from=half)
    assert resumed.select("image_path", "width").exceptAll(verified.select("image_path", "width")).isEmpty()
    assert resumed.count() == 76

    deleted = commands.delete_images(errors, data)
    assert deleted.filter("deleted").count() == 2 and not os.path.exists(data + "/d1/5.jpg")
    assert commands.delete_images(errors, data).filter("deleted").count() == 0

    head = LinearHead.from_centroids(
        spark.createDataFrame([("Adult", [1.0, 0.0]), ("Larva", [0.0, 1.0])], "label string, f array<double>"), "f", "label")
    feats = verified.withColumn("features", F.when(F.col("coreid") % 8 == 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.9))))
    preds = commands.predict_lifestage(feats, head)
    assert {r[0]: r[1] for r in preds.groupBy("life_stage_prediction").count().collect()} == {"Adult": 10, "Larva": 10}

    clean, report = commands.clean_dataset(meta, verified, preds)
    counts = {r["rule"]: r["images"] for r in report.collect()}
    assert counts == {"kept": 66, "non_adult": 10}
    split = commands.split_dataset(clean, max_instances=0)
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "val", "test"}

    rows = split.join(verified.select("image_path", "file_size"), "image_path")
    extra = rows.unionByName(rows.limit(1).withColumn("image_path", F.lit("d1/not_there.jpg")))
    out = str(archive / "shards")
    manifest = commands.create_webdataset(extra, data, out, max_shard_size=200_000, columns_to_json="coreid,lifeStage").collect()
    assert sum(m["samples"] for m in manifest) == 66 and len(manifest) > 3
    assert all(not f.endswith(".tmp") for f in os.listdir(out))
    with tarfile.open(manifest[0]["path"]) as tar:
        members = tar.getnames()
    assert len(members) == 3 * manifest[0]["samples"]

    pattern = out + "/shard-{000000..%06d}.tar" % (len(manifest) - 1)
    assert shards.webdataset_count(spark, pattern).agg(F.sum("images")).first()[0] == 66
    sample = shards.webdataset_scan(spark, pattern).filter("key = 'd1/1'").first()
    assert bytes(sample["jpg"]) == bmp_bytes(70, 80) and '"coreid":1' in sample["json"]


def test_crop_goes_to_json(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(bmp_bytes(100, 50))
    rows = spark.createDataFrame([("a.jpg", 7, 100, 50, os.path.getsize(tmp_path / "a.jpg"))], "image_path string, k long, width int, height int, file_size long")
    dets = spark.createDataFrame([("a.jpg", 0, 0.9, 0.0, 0.1, 0.5, 0.2)], "image string, pos int, conf double, x double, y double, width double, height double")
    out = str(tmp_path / "out")
    commands.create_webdataset(rows, str(tmp_path), out, label_column="k", detections=dets)
    got = shards.webdataset_scan(spark, out + "/*.tar").first()
    assert got["cls"] == "0" and got["json"] == '{"crop":{"left":0,"upper":0,"right":55,"lower":40}}'


def test_image_info_sentinels(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a+b 100%.jpg").write_bytes(bmp_bytes(3, 4))
    (tmp_path / "d" / "bad.jpg").write_bytes(b"xx")
    (tmp_path / "d" / "empty.jpg").write_bytes(b"")
    planned = spark.createDataFrame([("d/a+b 100%.jpg",), ("d/bad.jpg",), ("d/empty.jpg",), ("d/none.jpg",)], "image_path string")
    got = {r[0]: tuple(r)[1:] for r in images.export_verification(images.image_info(planned, str(tmp_path))).select(
        "image_path", "width", "height", "file_size", "corrupted").collect()}
    assert got == {"d/a+b 100%.jpg": (3, 4, 54 + 12 * 4, False), "d/bad.jpg": (-1, -1, -1, True),
                   "d/empty.jpg": (-1, -1, -1, True), "d/none.jpg": (-1, -1, -1, False)}


def test_incremental_verify_second_run_adds_nothing(spark, tmp_path):
    root, results, state = (str(tmp_path / n) for n in ("photos", "results", "state"))
    os.makedirs(root)
    for i in range(5):
        (tmp_path / "photos" / f"{i}.jpg").write_bytes(bmp_bytes(i + 1, 2))
    assert incremental_verify(spark, root, results, state, files_per_batch=2).count() == 5
    assert incremental_verify(spark, root, results, state).count() == 5
    (tmp_path / "photos" / "new.jpg").write_bytes(bmp_bytes(9, 9))
    assert incremental_verify(spark, root, results, state).count() == 6


def test_tree_cleanup(spark, tmp_path):
    for p in ("f1/g1/s1/a.jpg", "f1/g1/s2/b.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    taxa = images.path_taxonomy_scan(spark, str(tmp_path))
    allowed = spark.createDataFrame([("f1", "g1", "s1")], "family string, genus string, species string")
    gone = jobs.delete_job(jobs.not_allowed(taxa, allowed, "family", "genus", "species"), str(tmp_path), "image_path")
    assert [tuple(r) for r in gone.collect()] == [("f1/g1/s2/b.jpg", True)] and (tmp_path / "f1/g1/s1/a.jpg").exists()


def test_key_lists_and_tables(spark, tmp_path):
    (tmp_path / "keys.json").write_text('[12, "7", 3.0]')
    assert sorted(r[0] for r in documents.read_key_list(spark, str(tmp_path / "keys.json")).collect()) == [3, 7, 12]
    (tmp_path / "map.json").write_text('{"12": 0, "7": 1}')
    assert sorted(map(tuple, documents.read_json_map(spark, str(tmp_path / "map.json"), "int").collect())) == [("12", 0), ("7", 1)]
    df = spark.createDataFrame([("a,\"b", None), ("c", 2)], "name string, n int")
    tables.write_table(df, str(tmp_path / "csv"), "csv")
    assert tables.read_table(spark, str(tmp_path / "csv"), "name string, n int", "csv").exceptAll(df).isEmpty()
    (tmp_path / "tasks.json").write_text('[{"data": {"image": "u/x.jpg", "deployment": "UK"}, "annotations": []}]')
    assert documents.annotation_json_scan(spark, str(tmp_path / "tasks.json"), one_document=True).first()["data"]["image"] == "u/x.jpg"


def test_indented_and_broken_files(spark, tmp_path):
    (tmp_path / "map.json").write_text('{\n  "12": 0,\n  "7": 1\n}\n')
    (tmp_path / "keys.json").write_text('[\n  12,\n  "7"\n]\n')
    (tmp_path / "tasks.json").write_text('[\n {"data": {"image":\n "u/x.jpg"}}\n]')
    (tmp_path / "truth.json").write_text('{\n  "a": [\n    [[1, 2, 3, 4], [5, 6, 7, 8]],\n    [1, 0]\n  ]\n}')
    (tmp_path / "uneven.json").write_text('{"a": [[[1, 2, 3, 4]], [1, 0], [0.5]]}')
    path = {p.stem: str(p) for p in tmp_path.glob("*.json")}
    assert sorted(map(tuple, documents.read_json_map(spark, path["map"], "int", one_document=True).collect())) == [("12", 0), ("7", 1)]
    assert sorted(r[0] for r in documents.read_key_list(spark, path["keys"], one_document=True).collect()) == [7, 12]
    truth = documents.prediction_json_scan(spark, path["truth"], one_document=True).orderBy("pos").collect()
    assert [(r["image"], r["pos"], r["x1"], r["label"], r["score"]) for r in truth] == [("a", 0, 1.0, 1, None), ("a", 1, 5.0, 0, None)]
    for broken in (
        lambda: documents.read_json_map(spark, path["map"], "int"), lambda: documents.read_key_list(spark, path["keys"]),
        lambda: documents.annotation_json_scan(spark, path["tasks"]), lambda: documents.prediction_json_scan(spark, path["truth"]),
        lambda: documents.prediction_json_scan(spark, path["uneven"]),
    ):
        with pytest.raises(Exception, match="(?i)malformed|unequal"):
            broken().collect()


def test_large_and_oddly_named_images_come_back_whole(spark, tmp_path):
    boxes = spark.range(10_050).select(
        F.lit('a"b\\c').alias("image"), F.col("id").alias("box_id"), *[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        F.lit(1).alias("label"), (1 - F.col("id") / 20_000).alias("score"))
    documents.write_prediction_json(matching.nested_regroup(boxes), str(tmp_path / "preds"))
    back = documents.prediction_json_scan(spark, str(tmp_path / "preds"))
    assert tuple(back.agg(F.count("*"), F.countDistinct("image", "pos"), F.min("pos"), F.max("pos"), F.min("image")).first()) == (10_050, 10_050, 0, 10_049, 'a"b\\c')


def test_csv_keeps_line_breaks_and_refuses_bad_values(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1), ("c", 2)], "name string, n int")
    tables.write_table(df, str(tmp_path / "csv"), "csv")
    assert tables.read_table(spark, str(tmp_path / "csv"), "name string, n int", "csv").exceptAll(df).isEmpty()
    assert tables.read_table(spark, str(tmp_path / "csv"), "name string, n int", "csv").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, str(tmp_path / "csv"), "name int, n int", "csv").collect()


def test_label_files_round_trip(spark, tmp_path, rows):
    texts = spark.createDataFrame([("a b+1", "0 0.5 0.5 0.1 0.2\n3 1 1e-05 0.25 1\n"), ("c", "1 0.1 0.2 0.3 0.4\n")], "image string, content string")
    assert documents.yolo_label_sink(texts, str(tmp_path / "labels")) == 2
    got = rows(documents.yolo_label_scan(spark, str(tmp_path / "labels")), "image", "class_id", "yc")
    assert got == [("a b+1", 0, 0.5), ("a b+1", 3, 1e-05), ("c", 1, 0.2)]
