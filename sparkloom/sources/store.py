"""Files of a dataset's log, on any file system that Spark reaches."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

from ..errors import UnsupportedError

#: Schemes by the way in which a name is taken once: a rename (or link) that never overwrites, a create that never does,
#: a create on a condition.  Others are refused: their renames copy, and two writers could both win.
RENAMES, CREATES, CONDITIONAL = ("file", "hdfs", "viewfs"), ("abfs", "abfss", "gs"), ("s3a",)


class Store:
    """Whole small files below a root: read, list, remove, and write one only if its name is free."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def bare_root(self) -> str:
        """The root without scheme, as bare() gives paths."""
        return bare(self.root)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def get(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Writes the file whole, or not at all when another writer was first."""
        if self.exists(name):
            return False
        scheme = self.root.split(":", 1)[0]
        if scheme in CREATES or scheme in CONDITIONAL:
            return self._create(name, text, scheme in CONDITIONAL)
        if scheme not in RENAMES:
            raise UnsupportedError(f"{scheme}: no way is known to write a file only where there is none")
        temporary = f"_incoming/{uuid.uuid4().hex}"  # apart from what others list
        self._write(temporary, text)
        self._fs.mkdirs(self._path(os.path.dirname(name)))
        try:
            if self.root.startswith("file:"):
                os.link(bare(self.path(temporary)), bare(self.path(name)))
            else:  # a rename that refuses to overwrite
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), self._conf)
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
                options = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
                options[0] = none
                context.rename(self._path(temporary), self._path(name), options)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            if self.exists(temporary):
                self._fs.delete(self._path(temporary), False)

    def _create(self, name: str, text: str, conditional: bool) -> bool:
        """Creates the file by the store's own condition, which it checks when the whole is there."""
        builder = self._fs.createFile(self._path(name)).overwrite(False).recursive()
        if conditional:
            builder = builder.must("fs.option.create.conditional.overwrite", True)
        try:
            stream = builder.build()
            stream.write(bytearray(text.encode()))
            stream.close()
            return True
        except Exception as error:
            if "IllegalArgument" in str(error):
                raise UnsupportedError("this store's client has no conditional create") from error
            if self.exists(name):
                return self.get(name) == text and "FileAlreadyExists" not in str(error)  # written, and its answer lost
            raise

    def put(self, name: str, text: str) -> None:
        self._write(name, text)

    def list(self, folder: str, deep: bool = False) -> list[tuple[str, int, int]]:
        """Name below the root, bytes and milliseconds of change of each file in a folder."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        files = self._fs.listFiles(path, deep)
        out = []
        while files.hasNext():
            f = files.next()
            out.append((bare(f.getPath().toString())[len(self.bare_root) + 1 :], f.getLen(), f.getModificationTime()))
        return sorted(out)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move_in(self, source: str, name: str) -> None:
        """Copies a file below the root."""
        path = self._jvm.org.apache.hadoop.fs.Path(source)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(path.getFileSystem(self._conf), path, self._fs, self._path(name), False, self._conf)


def bare(path: str) -> str:
    """A path without its scheme, whatever number of slashes follows that."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path)
