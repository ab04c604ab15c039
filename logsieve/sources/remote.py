"""Opening files in tasks by ranges: a seekable file over whatever file system a path names.

Plain paths and ``file://`` are opened as they are. File systems that Arrow speaks are read by its range calls,
so a task fetches what it seeks to and no more. An ``opener``, "module:function" of a path, reads others; the
module must be importable in the tasks. What only Spark's JVM can reach is read whole by Spark's reader in the
tasks (``detect.read_files``), and by ranges on the driver (``storage.Storage.open``).
"""

from __future__ import annotations

import importlib
from typing import BinaryIO

#: Schemes that Arrow's file systems know, under the names it knows them by.
ARROW_SCHEMES = {"s3": "s3", "s3a": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "abfs": "abfs", "abfss": "abfss"}


def scheme_of(path: str) -> str:
    return path.partition("://")[0].lower() if "://" in path else ""


def in_tasks(path: str, opener: str | None = None) -> bool:
    """Whether tasks can open ``path`` by themselves."""
    return opener is not None or (scheme := scheme_of(path)) in ("", "file") or scheme in ARROW_SCHEMES


def open_ranged(path: str, opener: str | None = None) -> BinaryIO:
    """A binary file that can seek; only what is read is fetched."""
    if opener is not None:
        module, _, name = opener.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    scheme = scheme_of(path)
    if scheme in ("", "file"):
        return open(path.removeprefix("file://"), "rb")
    if scheme in ARROW_SCHEMES:
        found, inner = _arrow(path)
        return found.open_input_file(inner)
    raise OSError(f"no way to read {scheme}:// in a task")


def _arrow(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES[scheme_of(path)]}://{path.partition('://')[2]}")


def list_arrow(root: str, found=None, inner: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of every file under a folder of a file system that Arrow speaks, in order of path."""
    from pyarrow import fs

    if found is None:
        found, inner = _arrow(root)
    top = root.rstrip("/")
    files = found.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f"{top}/{f.path[len(inner.rstrip('/')) + 1 :]}", f.size) for f in files if f.type == fs.FileType.File)
