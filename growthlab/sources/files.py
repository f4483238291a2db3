"""Files on any file system that Spark knows, written through Hadoop's interface: beside their place first, then renamed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import SparkSession


def has_scheme(path: str | Path) -> bool:
    return "://" in str(path) or str(path).startswith("file:")


def within(folder: str | Path, name: str) -> str | Path:
    """The path of a file in a folder: text for a URL, else a Path."""
    return f"{str(folder).rstrip('/')}/{name}" if has_scheme(folder) else Path(folder) / name


def beside(path: str | Path, rename: Callable[[str], str]) -> str | Path:
    """The path of a file in the folder of another, of the name that rename makes of the other's."""
    folder, slash, name = str(path).rpartition("/")
    return f"{folder}{slash}{rename(name)}" if has_scheme(path) else Path(path).with_name(rename(Path(path).name))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder of ``spark.checkpoint.dir``, which all executors share. Unset, a local master gets a
    temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='growthlab-')}"
    return f"{folder.rstrip('/')}/growthlab/{name}-{uuid.uuid4().hex}"


class Files:
    """The file system of a path. Its local one writes no checksums beside files: others that change them don't know of those."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        place = self.at(path)
        self.system = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(place.getFileSystem(conf).makeQualified(place).toUri(), conf)
        self.system.setWriteChecksum(False)

    def at(self, path: str | Path):
        return self.jvm.org.apache.hadoop.fs.Path(str(path))

    def parts(self, folder: str) -> list[str]:
        """The part files that a job of Spark wrote into a folder, in the order of its tasks."""
        found = [str(s.getPath()) for s in self.system.listStatus(self.at(folder))]
        return sorted((p for p in found if p.rpartition("/")[2].startswith("part-")), key=lambda p: (int(p.rpartition("/")[2].split("-")[1]), p))

    def append(self, path: str, stream) -> None:
        """Copies a file into an open stream of the JVM."""
        own = self.system.open(self.at(path))
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, stream, 1 << 16, False)
        finally:
            own.close()

    def move(self, path: str, to: str | Path) -> None:
        """Puts a file in the place of another, if there is one."""
        self.system.mkdirs(self.at(to).getParent() or self.at("."))
        if self.system.exists(self.at(to)):
            self.system.delete(self.at(to), False)
        if not self.system.rename(self.at(path), self.at(to)):
            raise OSError(f"could not move {path} to {to}")

    def remove(self, path: str | Path) -> None:
        self.system.delete(self.at(path), True)


@contextmanager
def staging(spark: SparkSession, path: str | Path) -> Iterator[SimpleNamespace]:
    """files and folder: a hidden folder beside path, for what is to be put there at once. It is gone afterwards, whatever happens."""
    files, folder = Files(spark, path), str(beside(path, lambda name: f".{name}-{uuid.uuid4().hex}"))
    try:
        yield SimpleNamespace(files=files, folder=folder)
    finally:
        files.remove(folder)
        files.system.close()


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    """A small file of text, there as a whole or not at all."""
    with staging(spark, path) as stage:
        out = stage.files.system.create(stage.files.at(f"{stage.folder}/text"))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        stage.files.move(f"{stage.folder}/text", path)
