"""Small files of a table's log, on any file system that Spark reaches; creation is exclusive."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")
        self._local = self.root.removeprefix("file:") if self.root.startswith("file:") else None

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def walk(self, folder: str) -> list[tuple[str, int, int]]:
        """(name under the root, bytes, time of change in ms) of all files below a folder."""
        where = self._path(folder)
        if not self._fs.exists(where):
            return []
        out, each = [], self._fs.listFiles(where, True)
        while each.hasNext():
            s = each.next()
            out.append((s.getPath().toString().removeprefix(self.root + "/"), s.getLen(), s.getModificationTime()))
        return out

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Create a file with all its content at once and durably; False if it is there already."""
        spare = f"{name}.{uuid.uuid4().hex}.tmp"
        if self._local is not None:
            final, temp = f"{self._local}/{name}", f"{self._local}/{spare}"
            os.makedirs(os.path.dirname(final), exist_ok=True)
            with open(temp, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(temp, final)
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
            folder = os.open(os.path.dirname(final), os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
            return True
        stream = self._fs.create(self._path(spare), False)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        no_overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self._jvm.java.lang.reflect.Array.newInstance(no_overwrite.getClass(), 1)
        options[0] = no_overwrite
        try:
            context.rename(self._path(spare), self._path(name), options)
        except Exception:
            if self.exists(name):
                self.delete(spare)
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
