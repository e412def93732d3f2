"""Session helpers: builder defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "fieldlens") -> SparkSession:
    """Local session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session that names none (tests, laptops) falls back to a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    return _fallback_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/fieldlens-{purpose}-{uuid.uuid4().hex}"


def io_tasks(spark: SparkSession) -> int:
    """Tasks for work on files. Given as a number: rows that are only paths look small, and adaptive execution
    would merge partitions that stand for terabytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """The table written once as Parquet in the shared folder and read back, so later reads prune columns."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_fallback: dict[str, str] = {}


def _fallback_dir(spark: SparkSession) -> str:
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all hosts share in spark.checkpoint.dir; a temporary one is for local sessions")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="fieldlens-")
    return _fallback[app]
