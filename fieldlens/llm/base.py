"""What the operators of this package share: table reading, row identity, white space, streaming helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and normalisation rules; ``bytes.split()`` cuts at the same six characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text in one Arrow batch, so that a batch of very long texts still fits into a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: Arrow batches are cut by bytes, not only by rows (a smaller limit of
    the user stays), and shuffle files go when the job that wrote them is over instead of piling up over many jobs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    named = spark.conf.get(key, None)
    if named is None or not named.isdigit() or int(named) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_id``, ``_th``: identifies a row for joins back to its text, also when ids are null or repeated.

    Rows equal in both are the same text under the same id, so whatever is derived from the text holds for each.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.col(text)).alias("_th"),
    ]


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def slices(data: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about ``limit`` bytes each, so that numpy temporaries stay small; no text is cut."""
    start, held = 0, 0
    for i, d in enumerate(data):
        if held and held + len(d) > limit:
            yield start, i
            start, held = i, 0
        held += len(d)
    if start < len(data):
        yield start, len(data)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes of a string or binary column each; no row is cut. After every
    batch the worker hands back what it has freed, so that it does not keep the most that any batch has needed."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = held = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, held + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, held = stop, int(ends[stop - 1])
        give_back()


def give_back() -> None:
    """Returns freed memory to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # other C libraries than glibc have none
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of a polynomial hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, grown as needed."""
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        for base, keep in ((_BASE, "_POWERS"), (pow(_BASE, -1, 1 << 64), "_INVERSES")):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            globals()[keep] = np.cumprod(factors)
    return _POWERS[:n], _INVERSES[:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """``S`` with ``(S[j] - S[i]) * base**i``, the hash of ``b[i:j]`` for every i and j, modulo 2**64."""
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    _, inv = powers(len(b) + 1)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * inv[: len(b)], out=out[1:])
    return out


def keep_rows(docs: DataFrame, keys: DataFrame, copies: str | None = None) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (``_id``, ``_th`` as in ``row_key``), once each, with their own columns.

    With ``copies`` each row comes as often as that column of ``keys`` says. The join, the choice among repeated rows
    and the repetition use one shuffle of the rows.
    """
    key, th = row_key()
    own, named = ["__row_id", "__row_th"], ["__key_id", "__key_th", "__copies"]
    wanted = keys.groupBy(F.col("_id").alias(named[0]), F.col("_th").alias(named[1])).agg(
        F.sum(copies if copies else F.lit(1)).alias(named[2])
    )
    rows = docs.withColumns({own[0]: key, own[1]: th})
    rows = rows.join(wanted, (rows[own[0]] == wanted[named[0]]) & (rows[own[1]] == wanted[named[1]])).dropDuplicates(own)
    if copies:
        rows = rows.filter(F.col(named[2]) > 0).withColumn(own[0], F.explode(F.sequence(F.lit(1).cast("long"), F.col(named[2]))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
