"""Image files: verification and path taxonomy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions.image_headers import probe
from fieldlens.functions.names import path_part
from fieldlens.session import io_tasks
from fieldlens.sources import files


def relative(path: Column, root: str) -> Column:
    """Path below ``root``, whatever number of slashes the scheme came with."""
    bare = F.regexp_replace(path, "^file:/+", "/")
    base = root if "://" in root else "/" + root.removeprefix("file:").strip("/")
    base = base.removeprefix("file://").rstrip("/")
    return F.substr(bare, F.lit(len(base) + 2))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: relative path, size and time. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(
        relative(F.col("path"), root).alias("image_path"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("fetch_date"),
    )


VERIFIED = "image_path string, width int, height int, fetch_date timestamp, file_size bigint, corrupted boolean, unsupported boolean"


def _probed(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files.open_fs(root.rstrip("/"))
        for b in batches:
            names = b.column("image_path").to_pylist()
            rows = []
            for name, info in zip(names, fs.get_file_info([f"{base}/{n}" for n in names]), strict=True):
                if info.type != pafs.FileType.File:
                    rows.append((name, None, None, None, None, False, False))
                    continue
                with fs.open_input_file(info.path) as f:
                    width, height, state = probe(lambda at, n, f=f: _at(f, at, n), info.size)
                known = state == "ok"
                rows.append((name, width, height, info.mtime if known else None, info.size if known else None, state == "corrupted", state == "unsupported"))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.bool_(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            names = [c.split()[0] for c in VERIFIED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def verified_paths(paths: DataFrame, root: str) -> DataFrame:
    """VERIFIED columns of the images that are named, batch or stream. Files are opened one by one in tasks; a few ranges of each are
    read, no pixels. Nothing but what is named is opened or listed."""
    return paths.select("image_path").mapInArrow(_probed(root), VERIFIED)


def image_info(planned: DataFrame, root: str) -> DataFrame:
    """Width, height, time, size and corrupted flag of planned images; all null for a missing file.

    Files that are no image or not whole are corrupted; other image formats than JPEG, PNG, GIF, BMP, TIFF and WebP are
    unsupported, which is no reason to delete them. Freeze the result before files change: it is read again on every use.
    """
    paths = planned.select("image_path").distinct().repartition(io_tasks(planned.sparkSession))
    return verified_paths(paths, root)


def export_verification(info: DataFrame) -> DataFrame:
    """The text form: -1 for what is unknown, time as text."""
    return info.select(
        "image_path", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height")],
        F.coalesce(F.date_format("fetch_date", "yyyy-MM-dd HH:mm:ss"), F.lit("-1")).alias("fetch_date"),
        F.coalesce("file_size", F.lit(-1)).alias("file_size"), "corrupted",
    )


def path_taxonomy(df: DataFrame, path: str = "image_path") -> DataFrame:
    """filename, species, genus and family from the last four path parts."""
    parts = ("filename", "species", "genus", "family")
    return df.select(path, *[path_part(path, i + 1).alias(n) for i, n in enumerate(parts)])


def path_taxonomy_scan(spark: SparkSession, root: str) -> DataFrame:
    return path_taxonomy(listing(spark, root))


def tree_counts(taxa: DataFrame) -> DataFrame:
    """Files per family, genus and species of a tree."""
    per = taxa.groupBy("family", "genus", "species").agg(F.count("*").alias("_n"))
    sets = [[F.col(c)] for c in ("family", "genus", "species")]
    rows = per.groupingSets(sets, "family", "genus", "species").agg(F.sum("_n").alias("files"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "family").when(F.col("_g") == 5, "genus").otherwise("species")
    return rows.select(level.alias("level"), F.coalesce("family", "genus", "species").alias("name"), "files")
