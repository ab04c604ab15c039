"""Finding log files under a folder."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".gz", ".parquet")
#: Files that operating systems leave behind; they aren't even reported.
LITTER = frozenset({".ds_store", "thumbs.db", "desktop.ini", ".localized"})


@dataclass(frozen=True)
class Candidate:
    file_id: int
    path: str
    size: int


@dataclass(frozen=True)
class Skipped:
    path: str
    reason: str


@dataclass
class Scan:
    candidates: list[Candidate] = field(default_factory=list)
    skipped: list[Skipped] = field(default_factory=list)


def is_litter(name: str) -> bool:
    return name.lower() in LITTER or name.startswith("._")


def is_candidate(name: str) -> bool:
    return name.lower().endswith(SUFFIXES)


def scan_folder(root: str) -> Scan:
    """Every file under a local folder, links not followed: candidates in order of path, and what is skipped why.

    A candidate's id is its place among all candidates, whichever are ingested later.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    found: list[tuple[str, int]] = []
    out = Scan()
    for folder, _, names in os.walk(root, followlinks=False, onerror=lambda e: out.skipped.append(Skipped(str(e.filename), "unreadable"))):
        for name in names:
            path = os.path.join(folder, name)
            if is_litter(name) or os.path.islink(path):
                continue
            if not is_candidate(name):
                out.skipped.append(Skipped(path, "extension"))
                continue
            try:
                size = os.stat(path).st_size
                readable = os.access(path, os.R_OK)
            except OSError:
                size, readable = 0, False
            if not readable:
                out.skipped.append(Skipped(path, "unreadable"))
            elif not size:
                out.skipped.append(Skipped(path, "empty"))
            else:
                found.append((path, size))
    out.candidates = [Candidate(i, p, n) for i, (p, n) in enumerate(sorted(found))]
    out.skipped.sort(key=lambda s: s.path)
    return out


def list_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, reason) of all files under any folder that Spark can read but litter; contents aren't read.

    ``reason`` tells why a file is passed over and is null for candidates.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    candidate = reduce(or_, [name.endswith(x) for x in SUFFIXES])
    reason = F.when(~candidate, "extension").when(F.col("size") == 0, "empty")
    return files.where(~name.isin(*LITTER) & ~name.startswith("._")).withColumn("reason", reason)


def scan(spark: SparkSession, root: str) -> Scan:
    """Candidates and what is skipped of a folder in the local or any other file system."""
    if "://" not in root or root.startswith("file://"):
        return scan_folder(root.removeprefix("file://"))
    rows = list_folder(spark, root).orderBy("path").collect()  # names and sizes of files, not records
    found = [r for r in rows if r.reason is None]
    return Scan([Candidate(i, r.path, r.size) for i, r in enumerate(found)], [Skipped(r.path, r.reason) for r in rows if r.reason is not None])
