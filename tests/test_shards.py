"""Shard roll points against a sequential writer's, member indexes against streamed shards."""

import random
import tarfile

import pytest
from pyspark.sql import functions as F

from fieldlens.operators.ordering import hash_order
from fieldlens.plans import commands
from fieldlens.sources import shards


def sequential(sizes, limit, most):
    shard, held, count, out = -1, None, 0, []
    for size in sizes:
        if held is None or held >= limit or count >= most:
            shard, held, count = shard + 1, 0, 0
        held, count = held + size, count + 1
        out.append(shard)
    return out


@pytest.mark.parametrize(("piece", "most", "n"), [(64, 100_000, 300), (2, 100_000, 900), (1, 7, 900), (3, 5, 400)])
def test_shards_roll_like_a_sequential_writer(spark, monkeypatch, piece, most, n):
    monkeypatch.setattr(shards, "PIECE", piece)
    rnd = random.Random(n + piece)
    # some samples are larger than a whole piece, some have no bytes
    sizes = [rnd.choice([0, 1, 30, 99, 100, 101, rnd.randint(0, 250), 1500 if rnd.random() < 0.1 else 5]) for _ in range(n)]
    df = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate(sizes)], "key string, size long").repartition(5)
    got = shards.assign_shards(df, "size", "key", 100, 42, most).select("key", "shard", "size", hash_order(42, "key").alias("h")).collect()
    ordered = sorted(got, key=lambda r: (r["h"], r["key"]))
    assert len(got) == n and [r["shard"] for r in ordered] == sequential([r["size"] for r in ordered], 100, most)


def test_no_rows_make_no_shards(spark):
    df = spark.createDataFrame([], "key string, size long")
    assert shards.assign_shards(df, "size", "key", 100).count() == 0


def test_index_and_stream_agree_and_a_filter_reads_its_samples(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "RANGE_BYTES", 3_000)
    names = [f"ds{i % 3}/{'long name ' * (i % 17)}{i}" for i in range(300)]
    rows = spark.createDataFrame([(k, bytes([i % 251]) * (i * 7 % 1300), i % 5, '{"i": %d}' % i) for i, k in enumerate(names)], "sample_key string, jpg binary, cls int, meta string")
    out = str(tmp_path / "out")
    manifest = shards.webdataset_sink(rows, out, F.octet_length("jpg"), payload="jpg", metadata="meta", max_shard_size=60_000).collect()
    assert len(manifest) > 2
    stream = sorted(map(tuple, shards.webdataset_stream(spark, out + "/*.tar").collect()))
    ranged = shards.webdataset_scan(spark, out + "/*.tar")
    assert sorted(map(tuple, ranged.collect())) == stream and len(stream) == 300
    # one shard goes to several tasks
    spread = ranged.withColumn("task", F.spark_partition_id()).groupBy("path").agg(F.countDistinct("task").alias("n"))
    assert max(r["n"] for r in spread.collect()) > 1
    # without the files beside the shards, headers are walked; a shard that was written anew does not take an old index
    index = {(r["path"], r["key"]): [tuple(m) for m in r["members"]] for r in shards.webdataset_index(spark, out + "/*.tar").collect()}
    for p in (tmp_path / "out").glob("*" + shards.INDEX):
        p.unlink()
    walked = shards.webdataset_index(spark, out + "/*.tar")
    assert {(r["path"], r["key"]): [tuple(m) for m in r["members"]] for r in walked.collect()} == index
    with tarfile.open(manifest[0]["path"]) as tar:
        assert {m.offset_data for m in tar} == {m[1] for (path, _), ms in index.items() if path.endswith(manifest[0]["path"].rsplit("/", 1)[1]) for m in ms}
    wanted = names[17]
    only = shards.webdataset_scan(spark, index=walked.filter(F.col("key") == wanted)).collect()
    assert [tuple(r) for r in only] == [s for s in stream if s[1] == wanted]


def test_unmatched_labels_stop_the_command(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    rows = spark.createDataFrame([("a.jpg", 7, 1), ("b.jpg", 8, 1)], "image_path string, k long, file_size long")
    known = spark.createDataFrame([("7", 0)], "category string, class_id long")
    with pytest.raises(ValueError, match="8 .1 rows"):
        commands.create_webdataset(rows, str(tmp_path), str(tmp_path / "out"), label_column="k", category_map=known)
