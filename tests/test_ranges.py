"""Files read in byte ranges against readers of whole files, the ragged prediction files, and the jobs on them."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlens.operators import annotations
from fieldlens.schemas import ANNOTATION_TASK
from fieldlens.sources import csv_ranges, documents, jobs, json_ranges, ranges, tables


def random_csv(rnd, breaks):
    def value():
        k = rnd.random()
        if k < 0.15:
            return ""
        if k < 0.25:
            return '""'
        text = "".join(rnd.choice(["a", "é", " ", "x1", ",", "\n", '""', "b", breaks]) for _ in range(rnd.randint(1, 12)))
        if k < 0.7:
            return f'"{text}"'
        plain = "".join(c for c in text if c not in ',\n\r"')
        # a quote inside a value that has none in front is a character
        return f'{plain}"q"{plain}' if k < 0.8 and plain else plain

    lines = [f'{value()},{rnd.choice([7, 12, ""])},{value()}' for _ in range(rnd.choice([0, 1, 40, 200]))]
    return breaks.join(["name,n,other", *lines, "", *lines[:3]]) + rnd.choice(["", breaks])


@pytest.mark.parametrize("seed", range(3))
def test_csv_ranges_equal_the_whole_file_reader(spark, tmp_path, seed):
    rnd = random.Random(seed)
    path, schema = str(tmp_path / "t.csv"), "name string, n int, other string"
    with open(path, "w", newline="") as f:
        f.write(random_csv(rnd, "\r\n" if seed % 3 == 2 else "\n"))
    options = {"header": True, "escape": '"', "multiLine": True, "mode": "FAILFAST"}
    whole = spark.read.schema(schema).options(**options).csv(path)
    parts = csv_ranges.csv_scan(spark, path, schema, range_bytes=rnd.choice([60, 300]))
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_csv_ranges_over_several_files(spark, tmp_path):
    rows = [(i, "line\n" * (i % 40) + f'"{i}", end' * (i % 5) + "\n", i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, text string, part int")
    tables.write_table(df.repartition(3), str(tmp_path / "t"), "csv", partition_by=["part"])
    back = csv_ranges.csv_scan(spark, str(tmp_path / "t"), "id int, part int, text string", range_bytes=20_000)
    assert back.columns == ["id", "part", "text"] and back.rdd.getNumPartitions() > 8
    assert sorted((r.id, r.text, r.part) for r in back.collect()) == rows


class Here:
    """Ranges that are scanned in this process, so that the size of a read can be set."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, fn, _schema):  # noqa: N802
        return Here(list(fn(iter(self.batches))))

    def collect(self):
        return [r for b in self.batches for r in b.to_pylist()]


@pytest.mark.parametrize("read", [1, 3, 64, 1000, 1001, 1002])
def test_records_and_elements_over_many_reads(tmp_path, monkeypatch, read):
    monkeypatch.setattr(ranges, "READ_BYTES", read)
    rnd = random.Random(read)
    for size in (5, 41, 3000):
        text = random_csv(rnd, "\n")
        (tmp_path / "t.csv").write_text(text)
        listed = [random_json(rnd) for _ in range(20)]
        (tmp_path / "t.json").write_text(json.dumps(listed, indent=1))

        def cut(name):
            whole = (tmp_path / name).stat().st_size  # noqa: B023
            rows = [{"path": str(tmp_path / name), "start": i, "end": min(i + size, whole), "length": whole} for i in range(0, whole, size)]  # noqa: B023
            return Here([pa.RecordBatch.from_pylist(rows)])

        plan = [dict(zip(("path", "start", "end", "length", "inside", "breaks"), r, strict=True)) for r in csv_ranges._chained(cut("t.csv"))]
        records = Here([pa.RecordBatch.from_pylist(plan)]).mapInArrow(csv_ranges._records, "").collect()
        assert list(csv.reader(io.StringIO("\n".join(r["value"] for r in records), newline=""))) == [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
        names = [c.split()[0] for c in json_ranges.PLAN.split(", ")]
        plan = [dict(zip(names, r, strict=True)) for r in json_ranges._chained(cut("t.json"), 1)]
        elements = Here([pa.RecordBatch.from_pylist(plan)]).mapInArrow(json_ranges._elements(1), "").collect()
        assert [(r["position"], json.loads(r["value"])) for r in elements] == list(enumerate(listed))


def test_csv_ranges_refuse_broken_files(spark, tmp_path):
    for name, text in (("open", 'a,b\n1,"x\n'), ("wide", "a,b\n1,2,3\n"), ("kind", "a,b\nx,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception, match="(?i)malformed"):
            csv_ranges.csv_scan(spark, str(tmp_path / f"{name}.csv"), "a int, b string", range_bytes=4).collect()
    (tmp_path / "mac.csv").write_bytes(b"a,b\r1,2\r")
    with pytest.raises(Exception, match="carriage"):
        csv_ranges.csv_scan(spark, str(tmp_path / "mac.csv"), "a int, b string").collect()


def random_json(rnd, depth=0):
    k = rnd.random()
    if k < 0.3 or depth > 3:
        return rnd.choice(['a"b\\', "\\\\", "é☃", "x,y]{", '\n\t"', "", 1, 2.5, None, True, '\\"'])
    if k < 0.65:
        return [random_json(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["k", 'a"', "\\", "é", ":,"]) + str(i): random_json(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


@pytest.mark.parametrize("seed", range(3))
def test_json_ranges_equal_the_whole_document(spark, tmp_path, seed):
    rnd = random.Random(seed)
    n, size = rnd.choice([0, 1, 60]), rnd.choice([100, 400])
    listed = [random_json(rnd) for _ in range(n)]
    named = {f'k"{i}\\,é': v for i, v in enumerate(listed)}
    lay = {"indent": rnd.choice([None, 2]), "ensure_ascii": rnd.random() < 0.5}
    (tmp_path / "list.json").write_text(" \n" + json.dumps(listed, **lay) + "\n")
    (tmp_path / "map.json").write_text(json.dumps(named, **lay))
    (tmp_path / "lines.json").write_text("".join(json.dumps(v) + "\n\n" for v in listed))
    rows = json_ranges.json_elements(spark, str(tmp_path / "list.json"), 1, size).orderBy("position").collect()
    assert [(r.position, json.loads(r.value)) for r in rows] == list(enumerate(listed))
    rows = json_ranges.json_members(spark, str(tmp_path / "map.json"), size).orderBy("position").collect()
    assert [(r.key, json.loads(r.value)) for r in rows] == list(named.items())
    rows = json_ranges.json_lines(spark, str(tmp_path / "lines.json"), size).orderBy("position").collect()
    assert [json.loads(r.value) for r in rows] == listed


@pytest.mark.parametrize("text", ["[1,,2]", "[1,2", '{"a":[1}', '["x]', "[1}", "[1,]", '{"a":1}]', "7"])
def test_json_ranges_refuse_broken_documents(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="malformed"):
        json_ranges.json_elements(spark, str(tmp_path / "x.json"), 1, 2).collect()


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    tasks = [
        {"data": {"image": f"u/t{i}.jpg", "deployment": "UK"}, "annotations": [{"result": [{"id": str(k), "type": "labels", "value": {"labels": ["Moth"], "x": 1.5}} for k in range(i % 4)], "reviews": []}], "meta": {"ignored": [i]}}
        for i in range(500)
    ]
    (tmp_path / "tasks.json").write_text(json.dumps(tasks, indent=4))
    rows = json_ranges.json_elements(spark, str(tmp_path / "tasks.json"), 1, 10000)
    assert rows.rdd.getNumPartitions() > 8
    read = rows.select("position", F.from_json("value", ANNOTATION_TASK, {"mode": "FAILFAST"}).alias("t")).orderBy("position").collect()
    assert [(r.position, r.t.data.image, len(r.t.annotations[0].result)) for r in read] == [(i, f"u/t{i}.jpg", i % 4) for i in range(500)]
    scanned = documents.annotation_json_scan(spark, str(tmp_path / "tasks.json"), one_document=True)
    items = annotations.resolve_review(scanned).select("task_id", F.explode("items").alias("i")).select("task_id", "i.pos", "i.id")
    assert sorted(map(tuple, items.collect())) == [(i, k, str(k)) for i in range(500) for k in range(i % 4)]


def test_files_of_tracking_and_of_the_detector(spark, tmp_path):
    trap = {"a.jpg": [[[1, 2, 3, 4], [5, 6, 7, 8]], [1, 1], ["moth", "nonmoth"], ["Sp 1", "nonmoth"], [93, 71]], "b.jpg": [[], [], [], [], []]}
    (tmp_path / "trap.json").write_text(json.dumps(trap))
    rows = documents.classified_boxes_scan(spark, str(tmp_path / "trap.json")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("a.jpg", 0, 1.0, 2.0, 3.0, 4.0, 1, "moth", "Sp 1", 93.0), ("a.jpg", 1, 5.0, 6.0, 7.0, 8.0, 1, "nonmoth", "nonmoth", 71.0)]
    found = {
        "info": {"format_version": "1.2"}, "detection_categories": {"1": "animal", "2": "person"},
        "images": [
            {"file": "x/1.jpg", "max_detection_conf": 0.9, "detections": [{"category": "1", "conf": 0.9, "bbox": [0.1, 0.2, 0.3, 0.4]}, {"category": "2", "conf": 0.1, "bbox": [0, 0, 1, 1]}]},
            {"file": "x/2.jpg", "detections": []}, {"file": "x/3.jpg", "failure": "unreadable", "detections": None},
        ],
    }
    (tmp_path / "detector.json").write_text(json.dumps(found, indent=1))
    rows = documents.detector_results_scan(spark, str(tmp_path / "detector.json")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("x/1.jpg", 0, "1", 0.9, 0.1, 0.2, 0.3, 0.4), ("x/1.jpg", 1, "2", 0.1, 0.0, 0.0, 1.0, 1.0)]
    unknown = {
        "other": json.dumps({"a": [[[1, 2, 3, 4]], [1], [0.5], [0], [1], [2]]}), "kinds": json.dumps({"a": [[[1, 2, 3, 4]], [1], ["moth"], ["Sp"], ["high"]]}),
        "uneven": json.dumps({"a": [[[1, 2, 3, 4]], [1], ["moth"], [], [5]]}),
    }
    for name, text in unknown.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="(?i)malformed|unequal|cast"):
            documents.classified_boxes_scan(spark, str(tmp_path / f"{name}.json")).collect()
    with pytest.raises(Exception, match="(?i)malformed|unequal|cast"):
        documents.prediction_json_scan(spark, str(tmp_path / "trap.json"), one_document=True).collect()
    for name, image in (("unnamed", {"detections": [{"conf": 1, "bbox": [0, 0, 1, 1]}]}), ("short", {"file": "f", "detections": [{"conf": 1, "bbox": [0, 0, 1]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"images": [image]}))
        with pytest.raises(Exception, match="malformed"):
            documents.detector_results_scan(spark, str(tmp_path / f"{name}.json")).collect()


def test_crop_records(spark, tmp_path):
    (tmp_path / "crops").mkdir()
    records = [
        {"ground_truth": ["Sp 1", "SPECIES"], "binary_classification": "moth", "moth_classification": [["Sp 1", 0.75], ["Sp 2", 0.25]], "bbox_coordinates": ["0.5", "0.4", "0.1", "0.2"]},
        {"ground_truth": ["Non-Moth", "NA"], "binary_classification": "nonmoth", "moth_classification": "Not required", "bbox_coordinates": ["0.1", "0.1", "0.1", "0.1"]},
    ]
    for name in ("a", "b"):
        (tmp_path / "crops" / f"{name}_resnet50.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "crops" / "c_resnet50.json").write_text("[]")
    rows = documents.crop_records_scan(spark, str(tmp_path / "crops")).orderBy("image", "pos").collect()
    assert [(r.image, r.pos, r.gt, r.gt_rank, r.xc) for r in rows] == [
        (f"{n}_resnet50", i, *records[i]["ground_truth"], (0.5, 0.1)[i]) for n in ("a", "b") for i in (0, 1)]
    assert [tuple(p) for p in rows[0].predictions] == [("Sp 1", 0.75), ("Sp 2", 0.25)] and rows[1].predictions is None
    (tmp_path / "bad.json").write_text('[{"moth_classification": []}]')
    with pytest.raises(Exception, match="malformed"):
        documents.crop_records_scan(spark, str(tmp_path / "bad.json")).collect()


def test_copy_job_lays_files_out_once(spark, tmp_path):
    (tmp_path / "from").mkdir()
    for name in ("a", "b"):
        (tmp_path / "from" / f"{name}.png").write_bytes(name.encode() * 9_000_000)
    plan = spark.createDataFrame([("a.png", "1/a.png"), ("a.png", "1/a.png"), ("a.png", "2/a.png"), ("b.png", "2/b.png"), ("c.png", "2/c.png")], "source string, target string")
    done = jobs.copy_job(plan, str(tmp_path / "from"), str(tmp_path / "to"))
    assert sorted((r.target, r.status) for r in done.collect()) == [("1/a.png", "copied"), ("2/a.png", "copied"), ("2/b.png", "copied"), ("2/c.png", "missing")]
    assert (tmp_path / "to" / "2" / "b.png").read_bytes() == b"b" * 9_000_000
    (tmp_path / "to" / "1" / "a.png").write_bytes(b"cut")
    again = jobs.copy_job(plan, str(tmp_path / "from"), str(tmp_path / "to")).collect()
    assert sorted((r.target, r.status) for r in again) == [("1/a.png", "copied"), ("2/a.png", "present"), ("2/b.png", "present"), ("2/c.png", "missing")]


def test_sidecars_need_a_region_and_a_size(spark):
    tasks = spark.createDataFrame([(0, ("u/a.jpg", "UK 1")), (1, ("u/a.jpg", "Panama 2")), (2, ("u/b.png", "Vermont"))], "task_id long, data struct<image string, deployment string>")
    sizes = spark.createDataFrame([("a", 640, 480), ("b", 10, 20)], "image string, width int, height int")
    found = {r.image: r.content for r in annotations.region_sidecars(tasks, sizes).collect()}
    assert found["a"] == json.dumps({"region": "CentralAmerica", "image_width": 640, "image_height": 480}, indent=2)
    assert json.loads(found["b"]) == {"region": "NorthEasternAmerica", "image_width": 10, "image_height": 20}
    with pytest.raises(Exception, match="no size"):
        annotations.region_sidecars(tasks, sizes.limit(1)).collect()
    with pytest.raises(Exception, match="no region"):
        annotations.region_sidecars(tasks.withColumn("data", F.struct(F.col("data.image"), F.lit("Mars").alias("deployment"))), sizes).collect()


def test_label_files_list_taxonomy_first_and_stay_empty_without_labels(spark, tmp_path):
    lines = spark.createDataFrame([(5, "labels", 0, "0 a"), (5, "taxonomy", 2, "1 b"), (5, "taxonomy", 1, "2 c"), (1, "labels", 0, "9 z")], "task_id long, type string, pos long, line string")
    tasks = spark.createDataFrame([(1, ("u/p.jpg",)), (5, ("u/p.jpg",)), (6, ("u/q.jpg",))], "task_id long, data struct<image string>")
    texts = annotations.yolo_files(lines, tasks)
    assert sorted(map(tuple, texts.collect())) == [("p", "2 c\n1 b\n0 a\n"), ("q", "")]
    assert documents.yolo_label_sink(texts, str(tmp_path / "labels")) == 2
    assert sorted(map(tuple, documents.text_files_scan(texts.select("image"), str(tmp_path / "labels"), ".txt").collect())) == [("p", "2 c\n1 b\n0 a\n"), ("q", "")]


def test_records_of_partitioned_csv_meet_no_join(spark, tmp_path):
    """A join by path would take the records for as small as the list of ranges and send them through the driver."""
    rows = [(i, f"t{i}", i % 2 == 0, None if i % 3 else f"p{i % 6}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, start boolean, place string")
    tables.write_table(df.repartition(2), str(tmp_path / "t"), "csv", partition_by=["start", "place"])
    back = csv_ranges.csv_scan(spark, str(tmp_path / "t"), "id int, text string, start boolean, place string", range_bytes=100)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert "Join" not in back._jdf.queryExecution().optimizedPlan().toString()
