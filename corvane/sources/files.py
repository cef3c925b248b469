"""Small files on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Text files through Hadoop's file API, with atomic replacement."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """The names of the files and folders in a folder, which may not be there."""
        fs, where = self._fs(folder), self._path(folder)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def replace(self, path: str, text: str) -> None:
        """Writes a file beside ``path`` and renames it over it."""
        self._put(path, text, "OVERWRITE")

    def create(self, path: str, text: str) -> bool:
        """Writes a file beside ``path`` and renames it to it; false if there is such a file already."""
        try:
            self._put(path, text, "NONE")
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _put(self, path: str, text: str, rename: str) -> None:
        fs, new = self._fs(path), f"{path}.{uuid.uuid4().hex}"
        stream = fs.create(self._path(new), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf(rename)
        array = self._jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        array[0] = option
        where = fs.makeQualified(self._path(path))
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf).rename(
                fs.makeQualified(self._path(new)), where, array
            )
        finally:
            fs.delete(self._path(new), False)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
