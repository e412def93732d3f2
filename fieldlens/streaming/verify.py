"""Verification that picks up new files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.sources.images import VERIFIED, relative, verified_paths

# fixed values: the layout of Spark's binary file source
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def incremental_verify(spark: SparkSession, root: str, results: str, checkpoint: str, files_per_batch: int = 10_000) -> DataFrame:
    """Verify what arrived below ``root`` since the last run and return all results so far.

    The checkpoint remembers the files, and each batch is committed whole: a stopped run continues where it was. Only
    new files are opened, and only their headers and ends are read.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).load(root)
    )
    paths = stream.select(relative(F.col("path"), root).alias("image_path"))
    query = (
        verified_paths(paths, root).writeStream.format("parquet").option("path", results)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(VERIFIED).parquet(results)
