"""Metadata tables and archive members with declared schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.schemas import MEDIA, OCCURRENCE
from fieldlens.sources.csv_ranges import csv_scan


def archive_member(spark: SparkSession, path: str, fields: dict[str, str], row_order: bool = False) -> DataFrame:
    """Named columns of a tab separated archive member; lines with too many fields are skipped.

    Only the header line comes to the driver. ``row_order`` (file, block, line) restores the file order.
    """
    lines = spark.read.text(path)
    header = lines.first()[0]
    names = header.split("\t")
    # no more is split off a line than the last named field; a line that ends before a field has none
    parts = F.split("value", "\t", max(names.index(n) for n in fields) + 2)
    cols = [F.expr(f"try_cast(nullif(get(_p, {names.index(n)}), '') AS {t})").alias(n) for n, t in fields.items()]
    order = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    rows = lines.select("value", order.alias("row_order")) if row_order else lines
    # tabs are counted without a split, which would be made once for the filter and once for the columns
    tabs = F.octet_length("value") - F.octet_length(F.replace("value", F.lit("\t"), F.lit("")))
    kept = rows.filter((F.col("value") != header) & (F.col("value") != "") & (tabs < len(names))).withColumn("_p", parts)
    return kept.select(*cols, *(["row_order"] if row_order else []))


def dwca_scan(spark: SparkSession, multimedia: str, occurrence: str) -> tuple[DataFrame, DataFrame]:
    """Media (with row order) and occurrences of an extracted archive."""
    return archive_member(spark, multimedia, MEDIA, row_order=True), archive_member(spark, occurrence, OCCURRENCE)


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table. CSV values may hold line breaks; a value that does not fit its column fails the job, and a large CSV
    file is read in ranges by many tasks."""
    if fmt == "csv":
        return csv_scan(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**kept).csv(path)
    else:
        writer.format(fmt).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; pass partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
