"""Hadoop file system calls, so that namespaces may live on any store that Spark reads."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, *parts: str) -> bool:
        p = self.path(*parts)
        return self._fs(p).exists(p)

    def names(self, *parts: str) -> list[str]:
        p = self.path(*parts)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self.exists(*parts) else []

    def length(self, *parts: str) -> int:
        p = self.path(*parts)
        return self._fs(p).getContentSummary(p).getLength() if self.exists(*parts) else 0

    def delete(self, *parts: str) -> bool:
        p = self.path(*parts)
        return self._fs(p).delete(p, True)

    def read(self, *parts: str) -> str:
        p = self.path(*parts)
        stream = self._fs(p).open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Make a file that isn't there yet, whole at once; False if another was first.

        On a local disk a hard link, elsewhere the file system's rename without overwriting, decides who is first.
        """
        p, aside = self.path(*parts), self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        fs = self._fs(p)
        stream = fs.create(aside, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            if fs.getScheme() == "file":
                try:
                    os.link(aside.toUri().getPath(), p.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(aside, p, options)
            except Exception as e:  # a race that was lost is told by the file that is there
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        finally:
            fs.delete(aside, False)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> bool:
        """Rename a folder unless the target is there; False if it was, or the source is gone."""
        a, b = self.path(*source), self.path(*target)
        fs = self._fs(a)
        fs.mkdirs(b.getParent())
        return fs.exists(a) and not fs.exists(b) and fs.rename(a, b)
