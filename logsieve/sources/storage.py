"""Small files and folders in any file system that Spark can reach."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or a new one of a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="logsieve-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class RangedFile(io.RawIOBase):
    """A file of any file system that Spark's JVM reaches, on the driver; ``fetched`` counts the bytes that came."""

    def __init__(self, storage: Storage, path: str):
        super().__init__()
        fs, p = storage._at(path)
        self.size, self.stream, self.at, self.fetched = fs.getFileStatus(p).getLen(), fs.open(p), 0, 0
        self.utils = storage.jvm.org.apache.commons.io.IOUtils

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence])
        return self.at

    def read(self, size: int | None = -1) -> bytes:
        left = max(0, self.size - self.at)
        n = left if size is None or size < 0 else min(size, left)
        if not n:
            return b""
        self.stream.seek(self.at)
        data = bytes(self.utils.toByteArray(self.stream, n))
        self.at += len(data)
        self.fetched += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class Storage:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        found = self.jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.conf), found

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What a folder holds, in order; nothing if there is no such folder. Hidden files are left out."""
        fs, p = self._at(path)
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            return []
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith("."))

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """Move a folder to where nothing is yet."""
        fs, p = self._at(source)
        if not fs.rename(p, self._at(target)[1]):
            raise OSError(f"{source} can't be moved to {target}")

    def open(self, path: str) -> RangedFile:
        return RangedFile(self, path)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, path: str, text: str) -> bool:
        """Create a whole file unless there is one of that name; False if there is. Of several writers one succeeds."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "file":  # Hadoop looks and creates in two steps there; a link is made in one
            target = p.toUri().getPath()
            part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            out = fs.create(p, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def write(self, path: str, text: str) -> None:
        """Replace a file by one step, so a reader sees the old text or the new one."""
        part = f"{path}.{uuid.uuid4().hex}"
        fs, p = self._at(part)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(p, fs.makeQualified(self._at(path)[1]), options)
