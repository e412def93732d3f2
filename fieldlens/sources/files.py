"""File access inside tasks, on any file system Arrow knows (local, s3, gs, hdfs)."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark import TaskContext


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    uri = path if "://" in path else ("file://" + path.removeprefix("file:"))
    return pafs.FileSystem.from_uri(uri)


def file_size(fs: pafs.FileSystem, path: str) -> int | None:
    info = fs.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else None


def read_bytes(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def attempt_suffix() -> str:
    context = TaskContext.get()
    return f".{context.taskAttemptId()}.tmp" if context else ".tmp"


def publish(fs: pafs.FileSystem, part: str, path: str) -> None:
    """Give a finished file its name; when another attempt was first, that file stays."""
    try:
        fs.move(part, path)
    except OSError:
        if file_size(fs, path) is None:
            raise
        fs.delete_file(part)


def write_bytes(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Whole file or none: written under the task attempt's own name, then moved."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = path + attempt_suffix()
    with fs.open_output_stream(part) as f:
        f.write(data)
    publish(fs, part, path)


def copy_file(source_fs: pafs.FileSystem, source: str, target_fs: pafs.FileSystem, target: str, piece: int = 4 << 20) -> None:
    """Whole file or none, a piece in memory at a time."""
    target_fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    part = target + attempt_suffix()
    with source_fs.open_input_stream(source) as read, target_fs.open_output_stream(part) as write:
        while data := read.read(piece):
            write.write(data)
    publish(target_fs, part, target)


USER_AGENT = "fieldlens image fetcher"

Opener = Callable[[str, float], bytes]


def url_opener(url: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read()
