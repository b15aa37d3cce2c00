"""Files of a warehouse through Hadoop's FileSystem, so local disks, HDFS and object stores are alike."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Conflict, InvalidInput


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where the session names none and
    all runs in this process, as in tests, a temporary one is made, set, and removed at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise InvalidInput("spark.checkpoint.dir names no folder that all executors share")
        own = tempfile.mkdtemp(prefix="sedimenta-")
        atexit.register(shutil.rmtree, own, True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Storage:
    """create, read, list, delete under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def url(self, path: str) -> str:
        return f"{self.root}/{path}"

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def create(self, path: str, text: str, overwrite: bool = False) -> None:
        """Write a small text file that nobody ever sees in part; one that exists is a Conflict, or with ``overwrite`` replaced. It is written under another
        name and then gets its own in one step that never overwrites: a link on local disks, a rename elsewhere (atomic on HDFS)."""
        draft = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if overwrite:
                self._fs.delete(self._at(path), False)
            if self._fs.getUri().getScheme() == "file":
                name = lambda at: self._jvm.java.io.File(at.toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(name(self._at(path)), name(draft))
                except Py4JJavaError as e:
                    if "FileAlreadyExists" in e.java_exception.getClass().getName():
                        raise Conflict(path) from e
                    raise
            elif self._fs.exists(self._at(path)) or not self._fs.rename(draft, self._at(path)):
                raise Conflict(path)
        finally:
            self._fs.delete(draft, False)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def list(self, path: str) -> list[tuple[str, int, int, bool]]:
        """(name, bytes, changed in ms, is a folder), none where the folder isn't there."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in self._fs.listStatus(self._at(path))]

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._at(path), False)

    def remove_dir_all(self, path: str) -> bool:
        return self._fs.delete(self._at(path), True)


class Versioned:
    """A JSON document whose versions are files made exclusively: of two writers of
    the same version one gets a Conflict, and so does one whose version isn't the newest any more, however old it is."""

    def __init__(self, storage: Storage, folder: str, keep: int = 20):
        self.storage, self.folder, self.keep = storage, folder, keep

    def versions(self) -> list[int]:
        return sorted(int(name[1:-5]) for name, *_ in self.storage.list(self.folder) if name.startswith("v") and name.endswith(".json"))

    def _name(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}.json"

    def load(self) -> tuple[int, dict | None]:
        for _ in range(20):
            found = self.versions()
            if not found:
                return 0, None
            try:
                return found[-1], json.loads(self.storage.read(self._name(found[-1])))
            except Py4JJavaError:  # many others published meanwhile and it was removed as an old one
                if self.storage.exists(self._name(found[-1])):
                    raise
        raise Conflict(self.folder)

    def publish(self, version: int, document: dict) -> int:
        self.storage.create(self._name(version + 1), json.dumps(document))
        there = self.versions()
        # old versions are removed, so a writer that is far behind can make its file; the newest always stays and betrays it
        if there[-1] > version + 1:
            self.storage.delete(self._name(version + 1))
            raise Conflict(self._name(version + 1))
        for old in there[: -self.keep]:
            self.storage.delete(self._name(old))
        return version + 1
