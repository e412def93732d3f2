"""Per-file jobs: fetch and delete. They run once and return a frozen status table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators.ordering import ensure_checkpoint_dir
from fieldlens.session import io_tasks
from fieldlens.sources import files


def fetch_job(
    plan: DataFrame,
    dataset_path: str,
    cache_path: str | None = None,
    timeout: float = 30,
    workers: int | None = None,
    opener: files.Opener = files.url_opener,
) -> DataFrame:
    """(image_path, status): present, cached, fetched or the error; one bad address never stops the job.

    ``plan`` has image_path and identifier. A repeated task finds the finished files and goes on.
    """
    root = dataset_path.rstrip("/")
    cache_root = cache_path.rstrip("/") if cache_path else None

    def one(fs, cache_fs, base, cache_base, path, url) -> str:
        target = f"{base}/{path}"
        if files.file_size(fs, target) is not None:
            return "present"
        try:
            if cache_fs is not None and files.file_size(cache_fs, f"{cache_base}/{path}") is not None:
                files.write_bytes(fs, target, files.read_bytes(cache_fs, f"{cache_base}/{path}"))
                return "cached"
            files.write_bytes(fs, target, opener(url, timeout))
            return "fetched"
        except Exception as e:  # noqa: BLE001 - the reason goes to the status table
            return f"error: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = files.open_fs(root)
        cache_fs, cache_base = files.open_fs(cache_root) if cache_root else (None, None)
        for b in batches:
            done = [one(fs, cache_fs, base, cache_base, p, u) for p, u in zip(b["image_path"], b["identifier"], strict=True)]
            yield pd.DataFrame({"image_path": b["image_path"], "status": done})

    ensure_checkpoint_dir(plan.sparkSession)
    rows = plan.select("image_path", "identifier").repartition(workers or io_tasks(plan.sparkSession), "image_path")
    return rows.mapInPandas(run, "image_path string, status string").checkpoint()


def copy_job(plan: DataFrame, from_path: str, to_path: str, workers: int | None = None) -> DataFrame:
    """(source, target, status) of files that are laid out anew: copied, present (a file of the same size is there), missing
    (no such source) or the error. ``plan`` has source and target, paths below the two folders.

    A file is written whole or not at all, so a repeated task goes on; one that several rows name is copied once a target.
    """
    roots = from_path.rstrip("/"), to_path.rstrip("/")

    def one(source_fs, target_fs, source: str, target: str) -> str:
        try:
            size = files.file_size(source_fs, source)
            if size is None:
                return "missing"
            if files.file_size(target_fs, target) == size:
                return "present"
            files.copy_file(source_fs, source, target_fs, target)
            return "copied"
        except Exception as e:  # noqa: BLE001 - the reason goes to the status table
            return f"error: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (source_fs, source_base), (target_fs, target_base) = (files.open_fs(r) for r in roots)
        for b in batches:
            b["status"] = [one(source_fs, target_fs, f"{source_base}/{s}", f"{target_base}/{t}") for s, t in zip(b["source"], b["target"], strict=True)]
            yield b

    ensure_checkpoint_dir(plan.sparkSession)
    rows = plan.select("source", "target").distinct().repartition(workers or io_tasks(plan.sparkSession), "target")
    return rows.mapInPandas(run, "source string, target string, status string").checkpoint()


def delete_job(listed: DataFrame, base_path: str | None = None, column: str = "filename") -> DataFrame:
    """(filename, deleted) for every listed file; missing files are skipped."""
    root = base_path.rstrip("/") if base_path else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = files.open_fs(root) if root else (None, "")
        for b in batches:
            out = []
            for name in b[column]:
                f, path = (fs, f"{base}/{name}") if fs is not None else files.open_fs(name)
                found = files.file_size(f, path) is not None
                if found:
                    f.delete_file(path)
                out.append(found)
            yield pd.DataFrame({"filename": b[column], "deleted": out})

    ensure_checkpoint_dir(listed.sparkSession)
    names = listed.select(column).distinct().repartition(io_tasks(listed.sparkSession))
    return names.mapInPandas(run, "filename string, deleted boolean").checkpoint()


def not_allowed(listing: DataFrame, allowed: DataFrame, *levels: str) -> DataFrame:
    """Files of a tree whose taxon is not on the list, ready for ``delete_job``."""
    return listing.join(allowed.select(*levels).distinct(), list(levels), "left_anti")


def write_files(rows: DataFrame, root: str, path: str, content: str) -> int:
    """Write a binary column to files; returns how many were written."""
    base_uri = root.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = files.open_fs(base_uri)
        for b in batches:
            for p, c in zip(b[path], b[content], strict=True):
                files.write_bytes(fs, f"{base}/{p}", bytes(c))
            yield pd.DataFrame({"n": [len(b)]})

    spread = rows.select(path, content).repartition(io_tasks(rows.sparkSession))
    done = spread.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0]
    return done or 0
