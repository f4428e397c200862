"""Small questions to the cluster's file system, asked through Hadoop."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target)


def quoted(path: str) -> str:
    """``path`` as a SQL text."""
    escaped = path.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, which may be a pattern, leads to anything."""
    fs, target = _resolve(spark, pattern)
    return bool(fs.globStatus(target))


def listed_names(files: DataFrame) -> DataFrame:
    """``source_path`` of all files behind a scan, empty ones too, which no scan
    shows: the names are taken from the file index that the driver holds."""
    names = [(re.sub("^file:///", "file:/", name),) for name in files.inputFiles()]
    return files.sparkSession.createDataFrame(names, "source_path STRING")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every job within once it ends: they would stay
    until the driver happens to collect its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, which readers of the folder do not see if its name
    starts with an underscore."""
    fs, target = _resolve(spark, path)
    fs.create(target, True).close()


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder has anything a reader of it would see."""
    fs, target = _resolve(spark, path)
    if not fs.exists(target):
        return False
    names = (status.getPath().getName() for status in fs.listStatus(target))
    return any(name[0] not in "_." for name in names)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; nothing there is fine."""
    fs, target = _resolve(spark, path)
    fs.delete(target, True)


def full_path(spark: SparkSession, path: str) -> str:
    fs, target = _resolve(spark, path)
    return fs.makeQualified(target).toString()


def scanned_path(spark: SparkSession, source_path: str) -> str:
    """The full path of a file by the encoded name that scans report for it."""
    uri = spark._jvm.java.net.URI(source_path)
    return spark._jvm.org.apache.hadoop.fs.Path(uri).toString()


def file_names(spark: SparkSession, path: str) -> list[str]:
    """All files below a folder, named from there; none if it is not there.

    Folders are listed one by one: a recursive listing also asks for the owner and
    the blocks of every file, which a local disk answers by a process for each.
    """
    fs, target = _resolve(spark, path)
    if not fs.exists(target):
        return []
    root = fs.makeQualified(target).toString()
    names, folders = [], [target]
    while folders:
        for status in fs.listStatus(folders.pop()):
            if status.isDirectory():
                folders.append(status.getPath())
            else:
                names.append(status.getPath().toString()[len(root) + 1 :])
    return names


def move(spark: SparkSession, source: str, to: str) -> None:
    """Rename a file, making the folder it goes to."""
    fs, target = _resolve(spark, to)
    fs.mkdirs(target.getParent())
    if not fs.rename(_resolve(spark, source)[1], target):
        raise OSError(f"{source} could not be moved to {to}")


def write_names(spark: SparkSession, path: str, names: Iterable[str]) -> None:
    """A small text file with one name a line."""
    fs, target = _resolve(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray("".join(f"{name}\n" for name in names).encode()))
    finally:
        out.close()


def read_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _resolve(spark, path)
    source = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return text.split("\n")[:-1]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors share.

    Only a local session may do without such a folder.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a shared folder")
        root = tempfile.gettempdir()
    return f"{root}/feedworks/{label}-{uuid.uuid4().hex}"
