"""Training shards: tar files of {key}.jpg, {key}.cls and {key}.json members."""

from __future__ import annotations

import io
import itertools
import json
import re
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.operators.ordering import ensure_checkpoint_dir, hash_bucket, hash_order, ranked
from fieldlens.session import io_tasks, materialized
from fieldlens.sources import files

# fixed values
SHARD_BYTES = 100 * 1024 * 1024
SHARD_SAMPLES = 100_000
BATCH_BYTES = 8 * 1024 * 1024
#: Shard sizes of a piece of the order, bytes of a range of samples, ranges for a task of the session.
PIECE, RANGE_BYTES, RANGES = 64, 64 * 1024 * 1024, 4
#: More than a table has rows.
ROWS = 10**12
#: What the name of a shard's index ends with.
INDEX = ".members.json"


def _rolls(batches: Iterator[pa.RecordBatch], limit: int, most: int, leave: Callable) -> Iterator[pa.RecordBatch]:
    """``leave(piece, rows, nxt)`` of every piece, whose rows come together: ``rows`` holds places and bytes before of its rows and of
    those behind it that a shard may roll at, ``nxt`` the row at which a shard that begins at each row rolls (len(rows) at the end)."""
    now, held = None, []

    def close() -> pa.RecordBatch:
        at, before, own = (np.concatenate(c) for c in zip(*held, strict=True))
        nxt = np.minimum(np.maximum(np.searchsorted(before, before + limit), np.arange(len(at)) + 1), np.arange(len(at)) + most)
        return leave(now, at, before, int(own.sum()), np.minimum(nxt, len(at)))

    for b in batches:
        piece = b.column("piece").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for x, y in itertools.pairwise(edges):
            if y > x:
                if held and piece[x] != now:
                    yield close()
                    held = []
                now = int(piece[x])
                held.append((b.column("_at").to_numpy()[x:y], b.column("_before").to_numpy()[x:y], b.column("own").to_numpy(zero_copy_only=False)[x:y]))
    if held:
        yield close()


def _record(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def roll_points(placed: DataFrame, max_shard_size: int, max_count: int = SHARD_SAMPLES) -> DataFrame:
    """piece, shard, starts: the shards that begin in each piece of the order, the first one's number and their places.

    ``placed``, a stored table, has _at (place from 0), _before (bytes before the row) and _bytes. A shard takes samples until it holds
    ``max_shard_size`` bytes or ``max_count`` samples, so where it ends depends on where it begins, like a sequential
    writer's. The order is cut into pieces of PIECE shard sizes. In each piece, all at once, the places where a shard
    from the piece before may begin are followed to where that makes a shard begin in the next one; from the first row
    these functions are composed by pointer doubling, and every piece then rolls from its true beginning.
    """
    width = PIECE * max_shard_size
    rows = placed.select("_at", "_before", "_bytes")
    ends = rows.agg(F.coalesce(F.max("_bytes"), F.lit(0)), F.max("_before")).first()
    reach, last = max_shard_size + ends[0], -1 if ends[1] is None else ends[1] // width
    piece = F.floor(F.col("_before") / width)
    # rows near the beginning of a piece are seen from the one before; a very large sample may leave pieces without rows
    back = F.sequence(F.greatest(F.floor((F.col("_before") - reach) / width), F.lit(0)), piece)
    seen = rows.select(piece.alias("_piece"), F.explode(back).alias("piece"), "_at", "_before")
    seen = seen.withColumn("own", F.col("_piece") == F.col("piece")).select("piece", "_at", "_before", "own")
    laid = seen.repartition("piece").sortWithinPartitions("piece", "_at")

    def functions(batches):
        def leave(piece, at, before, own, nxt):
            heads = np.flatnonzero(before[:own] < piece * width + reach)
            ends = heads.copy()
            while len(on := np.flatnonzero(ends < own)):
                ends[on] = nxt[ends[on]]
            done = np.append(at, -1)[ends]
            return _record(["begin", "next"], [at[heads], done], [pa.int64(), pa.int64()])

        return _rolls(batches, max_shard_size, max_count, leave)

    # one beginning a piece is reached; jumps twice as long with every round
    jumps = [materialized(laid.mapInArrow(functions, "begin long, next long").filter("next >= 0"), "shard-jumps")]
    while 1 << len(jumps) <= last:
        step = jumps[-1]
        jumps.append(materialized(step.select("begin", F.col("next").alias("_mid")).join(
            step.select(F.col("begin").alias("_mid"), "next"), "_mid").select("begin", "next"), "shard-jumps"))
    reached = rows.filter("_at = 0").select(F.col("_at").alias("begin"))
    for step in reversed(jumps):
        reached = materialized(reached.unionByName(reached.join(step, "begin").select(F.col("next").alias("begin"))), "shard-begins")

    # the beginnings lie among the rows of their pieces, marked
    begins = reached.select(F.col("begin").alias("_begin")).distinct()
    marked = seen.join(begins, (F.col("_at") == F.col("_begin")) & F.col("own"), "left").select(
        (F.col("piece") * 2 + F.when(F.col("_begin").isNotNull(), 1).otherwise(0)).alias("piece"), "_at", "_before", "own")
    spread = marked.withColumn("_mark", F.col("piece") % 2).withColumn("piece", F.floor(F.col("piece") / 2))
    laid = spread.repartition("piece").sortWithinPartitions("piece", "_at").select("piece", "_at", "_before", "own", "_mark")
    starts = laid.mapInArrow(_starts(max_shard_size, max_count), "piece long, starts array<long>")
    starts = materialized(starts, "shard-starts")
    # an entry a piece
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return starts.withColumn("shard", F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)))


def _starts(limit: int, most: int):
    def run(batches):
        marks: dict[int, int] = {}

        def noted():
            for b in batches:
                for i in np.flatnonzero(b.column("_mark").to_numpy()).tolist():
                    marks[b.column("piece")[i].as_py()] = b.column("_at")[i].as_py()
                yield b

        def leave(piece, at, before, own, nxt):
            found, i = [], int(np.searchsorted(at, marks.pop(piece))) if piece in marks else own
            while i < own:
                found.append(int(at[i]))
                i = int(nxt[i])
            return _record(["piece", "starts"], [[piece], [found]], [pa.int64(), pa.list_(pa.int64())])

        return _rolls(noted(), limit, most, leave)

    return run


def _running(rows: DataFrame, order: list[Column], bucket: Column, amount: Column) -> DataFrame:
    """``_run``: the running total of an amount wider than a long."""
    base = rows.withColumn("_b", bucket).withColumn("_a", amount)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("_b").agg(F.sum("_a").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).cast("decimal(38,0)").alias("_off"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return base.withColumn("_in", F.sum("_a").over(inside).cast("decimal(38,0)")).join(offsets, "_b").withColumn(
        "_run", (F.col("_off") + F.col("_in")).cast("decimal(38,0)"))


def assign_shards(
    rows: DataFrame, size: str | Column, key: str, max_shard_size: int = SHARD_BYTES, seed: int = 42, max_count: int = SHARD_SAMPLES
) -> DataFrame:
    """Rows with ``shard``, in seeded random order, rolled as a sequential writer rolls them: a shard that holds
    ``max_shard_size`` bytes or ``max_count`` samples is followed by the next one."""
    hashed = rows.withColumn("_h", hash_order(seed, key)).withColumn("_bytes", (F.col(size) if isinstance(size, str) else size).cast("long"))
    h = F.col("_h")
    order, bucket = [h, F.col(key)], hash_bucket(h, 4)
    # one running total of bytes and rows: bytes are counted in a unit above any number of rows
    both = (F.col("_bytes").cast("decimal(38,0)") * F.lit(ROWS) + 1).cast("decimal(38,0)")
    run = _running(hashed.select("_h", key, "_bytes"), order, bucket, both)
    placed = materialized(run.select(
        key, (F.col("_run") % ROWS - 1).cast("long").alias("_at"), (F.expr(f"_run div {ROWS}") - F.col("_bytes")).cast("long").alias("_before"), "_bytes",
    ), "shard-places")
    starts = roll_points(placed, max_shard_size, max_count)
    piece = F.floor(F.col("_before") / (PIECE * max_shard_size))
    before = F.size(F.filter("starts", lambda s: s <= F.col("_at")))
    numbered = placed.withColumn("piece", piece).join(starts, "piece").select(F.col(key).alias("_k"), (F.col("shard") + before - 1).alias("shard"))
    # rows of one key stay together, in the shard of the first
    numbered = numbered.groupBy("_k").agg(F.min("shard").alias("shard"))
    return hashed.drop("_bytes").join(numbered, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def webdataset_sink(
    rows: DataFrame,
    out_dir: str,
    size: str | Column,
    label: str = "cls",
    key: str = "sample_key",
    payload: str | None = None,
    image_path: str | None = None,
    dataset_path: str | None = None,
    metadata: str | None = None,
    max_shard_size: int = SHARD_BYTES,
    name: str = "shard-%06d.tar",
    seed: int = 42,
) -> DataFrame:
    """Write tar shards with an index of their members beside them; returns the manifest (shard, path, samples, bytes).

    ``size`` is that of the image; label and metadata count as well.

    Bytes come from the ``payload`` column or, without shuffling any image, from files read by the task that
    writes the shard (missing files are skipped). Rows of a shard stream through one task in order; a shard
    appears under its name only when it is whole, so a repeated task replaces nothing half written.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    image_size = F.col(size) if isinstance(size, str) else size
    whole = image_size + F.octet_length(F.col(label).cast("string"))
    if metadata:
        whole = whole + F.octet_length(metadata)
    placed = assign_shards(rows, whole, key, max_shard_size, seed)
    cols = [c for c in ("shard", "_h", key, label, payload, image_path, metadata) if c]
    laid = placed.select(*cols).repartition(io_tasks(rows.sparkSession), "shard").sortWithinPartitions("shard", "_h")
    out_uri, source_uri = out_dir.rstrip("/"), (dataset_path or "").rstrip("/")

    def add(tar: tarfile.TarFile, member: str, data: bytes) -> int:
        info = tarfile.TarInfo(member)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
        return len(data)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = files.open_fs(out_uri)
        src_fs, src = files.open_fs(source_uri) if image_path else (None, "")
        fs.create_dir(base, recursive=True)
        samples = (row for b in batches for row in b.to_dict("records"))
        for shard, members in itertools.groupby(samples, key=lambda r: r["shard"]):
            path = f"{base}/{name % shard}"
            part = path + files.attempt_suffix()
            count = total = 0
            index = []
            with fs.open_output_stream(part) as stream, tarfile.open(fileobj=stream, mode="w|") as tar:
                for r in members:
                    if payload:
                        data = bytes(r[payload])
                    elif files.file_size(src_fs, f"{src}/{r[image_path]}") is None:
                        continue
                    else:
                        data = files.read_bytes(src_fs, f"{src}/{r[image_path]}")
                    members_of = {"cls": str(r[label]).encode(), "jpg": data} | ({"json": r[metadata].encode()} if metadata else {})
                    for ext, content in members_of.items():
                        add(tar, f"{r[key]}.{ext}", content)
                        index.append((r[key], ext, tar.offset - -(-len(content) // 512) * 512, len(content)))
                    total += len(data)
                    count += 1
            files.publish(fs, part, path)
            files.write_bytes(fs, path + INDEX, json.dumps({"bytes": files.file_size(fs, path), "members": index}).encode())
            yield pd.DataFrame({"shard": [shard], "path": [path], "samples": [count], "bytes": [total]})

    return laid.mapInPandas(write, "shard bigint, path string, samples bigint, bytes bigint").checkpoint()


def expand_braces(pattern: str) -> list[str]:
    """``a-{000..012}.tar`` and ``a-{x,y}.tar`` as path lists."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    body = found.group(1)
    span = re.fullmatch(r"(\d+)\.\.(\d+)", body)
    if span:
        width = len(span.group(1)) if span.group(1).startswith("0") else 0
        choices = [str(i).zfill(width) for i in range(int(span.group(1)), int(span.group(2)) + 1)]
    else:
        choices = body.split(",")
    return [p for c in choices for p in expand_braces(pattern[: found.start()] + c + pattern[found.end() :])]


def _shard_paths(spark: SparkSession, pattern: str) -> DataFrame:
    listed = spark.read.format("binaryFile").load(expand_braces(pattern)).select("path")
    return listed.repartition(io_tasks(spark), "path")


def webdataset_count(spark: SparkSession, pattern: str, ext: str = "jpg") -> DataFrame:
    """(path, images) per shard; tars are streamed, not loaded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                fs, p = files.open_fs(path)
                with fs.open_input_stream(p) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                    n = sum(1 for m in tar if m.name.endswith(ext))
                yield pd.DataFrame({"path": [path], "images": [n]})

    return _shard_paths(spark, pattern).mapInPandas(count, "path string, images bigint")


def webdataset_index(spark: SparkSession, pattern: str) -> DataFrame:
    """path, sample (its number in the shard), key, members (ext, offset, size) of every sample of a shard list.

    The index beside a shard is taken if it was made for a file of this size; other shards are walked from header to
    header, without reading what lies between. Keep the result as a table where shards are read often.
    """

    def members(fs, path: str) -> Iterator[tuple[str, str, int, int]]:
        size = files.file_size(fs, path)
        if files.file_size(fs, path + INDEX) is not None:
            known = json.loads(files.read_bytes(fs, path + INDEX))
            if known["bytes"] == size:
                yield from known["members"]
                return
        with fs.open_input_file(path) as stream, tarfile.open(fileobj=stream, mode="r:") as tar:
            for m in tar:
                if m.isfile():
                    key, _, ext = m.name.partition(".")
                    yield key, ext, m.offset_data, m.size
                tar.members.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            fs, p = files.open_fs(path)
            held = []
            for i, (key, parts) in enumerate(itertools.groupby(members(fs, p), key=lambda m: m[0])):
                held.append({"path": path, "sample": i, "key": key, "members": [{"ext": e, "offset": o, "size": n} for _, e, o, n in parts]})
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    part = pa.struct([("ext", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])
    schema = pa.schema([("path", pa.string()), ("sample", pa.int64()), ("key", pa.string()), ("members", pa.list_(part))])
    return _shard_paths(spark, pattern).mapInArrow(run, "path string, sample long, key string, members array<struct<ext:string,offset:long,size:long>>")


def webdataset_scan(spark: SparkSession, pattern: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(path, key, jpg, cls, json) samples of a shard list, or of the rows of its ``index``.

    The samples of one shard are dealt to tasks in ranges of RANGE_BYTES; a filter on the index (by key, by path) reads
    the bytes of its samples and no others.
    """
    index = webdataset_index(spark, pattern) if index is None else index
    first, last = F.col("members")[0], F.element_at("members", -1)
    rows = index.select("path", "key", "members", first["offset"].alias("_from"), (last["offset"] + last["size"]).alias("_to"))
    # a number of tasks: rows that say where bytes lie look small
    dealt = rows.repartition(RANGES * io_tasks(spark), "path", F.floor(F.col("_from") / RANGE_BYTES)).sortWithinPartitions("path", "_from")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now, stream = [], 0, None, None
        try:
            for r in (r for b in batches for r in b.itertuples(index=False)):
                if r.path != now:
                    if stream is not None:
                        stream.close()
                    fs, p = files.open_fs(r.path)
                    now, stream = r.path, fs.open_input_file(p)
                data = stream.read_at(int(r[4] - r[3]), int(r[3]))
                found = {m["ext"]: data[m["offset"] - r[3] : m["offset"] - r[3] + m["size"]] for m in r.members}
                text = [found[e].decode() if e in found else None for e in ("cls", "json")]
                held.append((r.path, r.key, found.get("jpg"), *text))
                size += len(data)
                # batches are cut by bytes, images being of any size
                if size > BATCH_BYTES or len(held) >= 2000:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        finally:
            if stream is not None:
                stream.close()
        if held:
            yield pd.DataFrame(held, columns=columns)

    columns = ["path", "key", "jpg", "cls", "json"]
    return dealt.mapInPandas(read, "path string, key string, jpg binary, cls string, json string")


def webdataset_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """The same samples with every shard read from its beginning by one task, for stores without ranged reads."""

    def samples(path: str) -> Iterator[tuple]:
        fs, p = files.open_fs(path)
        with fs.open_input_stream(p) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
            parts = ((m.name.split(".", 1), tar.extractfile(m).read()) for m in tar if m.isfile())
            for key, members in itertools.groupby(parts, key=lambda x: x[0][0]):
                found = {name[1]: data for name, data in members}
                text = [found[e].decode() if e in found else None for e in ("cls", "json")]
                yield path, key, found.get("jpg"), *text

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for sample in (x for b in batches for path in b["path"] for x in samples(path)):
            held.append(sample)
            size += len(sample[2] or b"")
            # batches are cut by bytes, images being of any size
            if size > BATCH_BYTES or len(held) >= 2000:
                yield pd.DataFrame(held, columns=columns)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    columns = ["path", "key", "jpg", "cls", "json"]
    return _shard_paths(spark, pattern).mapInPandas(rows, "path string, key string, jpg binary, cls string, json string")
