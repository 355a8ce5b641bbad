"""Folders of any file system that Spark reads, by way of its own file-system classes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; only where it is unset and the master is local, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="weirflow-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Folder:
    """A folder; a passing one goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, path: str, passing: bool = False) -> None:
        self.root = path.rstrip("/")
        self._spark = spark
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        top = self._Path(self.root)
        self._fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        # Its rename, unlike that of _fs, never moves into or over what has the name.
        files = spark._jvm.org.apache.hadoop.fs.FileContext
        self._context = files.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(top)
        if passing:
            self._fs.deleteOnExit(top)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, name: str = "") -> list[str]:
        at = self._Path(self.path(name) if name else self.root)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._Path(self.path(name)))

    def size(self, name: str) -> int:
        """Bytes of all files below a name."""
        return self._fs.getContentSummary(self._Path(self.path(name))).getLength()

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._Path(self.path(name)))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write beside and rename; False, without effect, if the name is there already."""
        beside = f".{uuid.uuid4().hex}"
        stream = self._fs.create(self._Path(self.path(beside)), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.rename(beside, name):
            return True
        self.delete(beside)
        return False

    # Texts that change are numbered files, of which the last is in force: a new one is put in place before an old one goes.

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n[len(name) + 1 :]) for n in self.names() if n.startswith(name + ".") and n[len(name) + 1 :].isdigit())

    def has_text(self, name: str) -> bool:
        return bool(self._numbers(name))

    def read_text(self, name: str) -> str:
        return self._read(f"{name}.{self._numbers(name)[-1]:012d}")

    def write_text(self, name: str, text: str) -> None:
        held = self._numbers(name)
        if not self.write_new(f"{name}.{held[-1] + 1 if held else 1:012d}", text):
            raise FileExistsError(f"another writer changed {name} at the same time")
        for n in held[:-1]:
            self.delete(f"{name}.{n:012d}")

    def rename(self, name: str, to: str) -> bool:
        """False if the new name is there already, which then stays as it was."""
        ends = [self._context.makeQualified(self._Path(self.path(n))) for n in (name, to)]
        none = self._spark.sparkContext._gateway.new_array(self._spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(*ends, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._Path(self.path(name)), True)
