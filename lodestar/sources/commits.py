"""Numbered versions of a folder, each one small file that appears whole or not at all and is never overwritten.

Two writers cannot both make a version. The text goes to a file of another name first, and that file gets the version's name
only if nothing has it: by a hard link on local file systems, by a rename that does not overwrite elsewhere. Object stores have
no such rename, but there a created file appears when it is closed, in one request, which is conditional if conditional writes
are enabled. So a writer that dies leaves at most a file of another name, which remove_stale() removes; nobody has to wait for it.
An empty version file (as earlier versions of this class could leave) is no version; its number is passed over.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

#: Stores where a file appears when it is closed.
OBJECT_STORES = ("s3", "s3a", "gs", "abfs", "abfss", "oss", "cos", "cosn")


class Commits:
    """The versions 1, 2, .. in folder; each has a text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.folder = folder
        self.fs = self.path(folder).getFileSystem(self.conf)

    def _files(self) -> list[tuple[int, int, float]]:
        """(version, bytes, time of change in seconds), newest version first."""
        found = ((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self._listed())
        return sorted(((int(n[1:]), size, at) for n, size, at in found if n[:1] == "v" and n[1:].isdigit()), reverse=True)

    def _listed(self) -> list:
        root = self.path(self.folder)
        return list(self.fs.listStatus(root)) if self.fs.exists(root) else []

    def newest(self) -> int:
        """The newest version; 0 before the first."""
        return next((n for n, size, _ in self._files() if size), 0)

    def text(self, version: int) -> str:
        stream = self.fs.open(self._file(version))
        try:
            size = self.fs.getFileStatus(self._file(version)).getLen()
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def add(self, text: str, after: int) -> int:
        """Make text the version that follows `after`; an error if somebody else has made that version. Returns its number."""
        if not text:
            raise ValueError("a version needs a text")
        later = [(n, size) for n, size, _ in self._files() if n > after]
        number = max([after, *(n for n, _ in later)]) + 1
        if any(size for _, size in later) or not self._publish(text, self._file(number)):
            raise RuntimeError(f"version {number} of {self.folder} is already committed")
        return number

    def _publish(self, text: str, target) -> bool:
        """Make the file target with this text; whether it was not there yet."""
        scheme = self._scheme()
        if scheme in OBJECT_STORES:
            try:
                self._write(text, target)
            except Exception:
                if self.fs.exists(target):
                    return False
                raise
            return True
        draft = self.path(f"{self.folder}/_{uuid.uuid4().hex}")
        self._write(text, draft)
        try:
            if scheme == "file":
                nio = self.jvm.java.nio.file
                local = lambda p: nio.Path.of(self.jvm.java.net.URI("file", "", p.toUri().getPath(), None))
                nio.Files.createLink(local(target), local(draft))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(draft, target, none)
        except Exception:
            if self.fs.exists(target):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)
        return True

    def _scheme(self) -> str:
        return self.fs.getUri().getScheme()

    def _write(self, text: str, path) -> None:
        stream = self.fs.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def remove_stale(self, seconds: float, keep: int) -> None:
        """Remove versions below `keep`, empty ones and drafts, if they are older than `seconds`."""
        for version, size, at in self._files():
            if (version < keep or not size) and time.time() - at >= seconds:
                self.fs.delete(self._file(version), False)
        for status in self._listed():
            if status.getPath().getName().startswith("_") and time.time() - status.getModificationTime() / 1000 >= seconds:
                self.fs.delete(status.getPath(), False)

    def _file(self, version: int):
        return self.path(f"{self.folder}/v{version:08d}")
