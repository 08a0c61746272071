"""Small driver-side file operations through Hadoop's FileSystem, so that any store that Spark reads will do."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def exists(self, *parts: str) -> bool:
        p = self.path(*parts)
        return self._fs(p).exists(p)

    def names(self, *parts: str) -> list[str]:
        p = self.path(*parts)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make(self, *parts: str) -> None:
        p = self.path(*parts)
        self._fs(p).mkdirs(p)

    def read(self, *parts: str) -> str:
        p = self.path(*parts)
        stream = self._fs(p).open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, text: str, *parts: str) -> bool:
        """Make a file that must not exist yet, whole or not at all; False if another writer was first.

        The text goes to a scratch name, which then becomes the file by one step that fails if the name is taken: a hard
        link on local disks, a rename without overwriting (FileContext) elsewhere. A store that has neither (an object
        store without conditional writes) is safe for one writer only.
        """
        to, scratch = self.path(*parts), self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        fs = self._fs(to)
        if fs.exists(to):
            return False
        stream = fs.create(scratch, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(scratch.toUri().getPath(), to.toUri().getPath())
            else:
                hadoop = self._jvm.org.apache.hadoop.fs
                never = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
                never[0] = getattr(hadoop, "Options$Rename").NONE
                hadoop.FileContext.getFileContext(to.toUri(), self._conf).rename(scratch, to, never)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(scratch, False)
        return True

    def modified(self, *parts: str) -> dict[str, float]:
        """Names in a folder, with the time in seconds when each was last changed."""
        p = self.path(*parts)
        fs = self._fs(p)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p)} if fs.exists(p) else {}

    def delete(self, *parts: str) -> None:
        p = self.path(*parts)
        self._fs(p).delete(p, True)
