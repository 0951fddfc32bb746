"""A bounded chat log that is appended to and trimmed in one step (ids A6, A8, G2).

The log is a folder of immutable versions and a pointer to the one that counts:

* ``versions/<number>-<unique>``: a whole log (parquet), written once;
* ``pointers/<number>``: the name of that version's folder. The greatest number counts.

A writer makes a version of the newest ``keep`` rows of the version before and the new rows, and
then moves a finished pointer file to the next number, a move that fails if that number is
taken: a writer that lost starts again on the winner's version, so no append is lost.
A reader sees the log as it was before or after an append, never a mix. An append that
fails leaves the pointer alone and removes its version. Versions before the last ``KEPT_VERSIONS`` are deleted:
a reader that started so long ago has to read again. (The move must be refused for a taken name,
as HDFS does; object stores need a committer that gives the same promise.)
"""

from __future__ import annotations

import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators import chatlog as C
from .files import SourceError, log_rows

KEPT_VERSIONS = 3
TRIES = 20


class _Folder:
    """The few file operations that the log needs, through the session's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self._path(self.root)
        self.fs = at.getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(at).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self.no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self.no_overwrite[0] = rename.NONE

    def path(self, name: str):
        return self.fs.makeQualified(self._path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, content: str) -> bool:
        """Put a whole file in place at once; False if the name is taken."""
        part = self.path(f"parts/{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        try:
            self.context.rename(part, self.path(name), self.no_overwrite)
            return True
        except Py4JJavaError as exc:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _last(folder: _Folder) -> int:
    return max((int(n) for n in folder.names("pointers") if n.isdigit()), default=-1)


def read_log(spark: SparkSession, root: str) -> DataFrame | None:
    """The log as it is now (None if it has no version yet)."""
    folder = _Folder(spark, root)
    number = _last(folder)
    if number < 0:
        return None
    return spark.read.parquet(f"{folder.root}/versions/{folder.read(f'pointers/{number:012d}')}")


def _replace(spark: SparkSession, root: str, make) -> int:
    """Write ``make(log now or None)`` as the next version; its number."""
    folder = _Folder(spark, root)
    for _ in range(TRIES):
        number = _last(folder) + 1
        now = None
        if number:
            now = spark.read.parquet(f"{folder.root}/versions/{folder.read(f'pointers/{number - 1:012d}')}")
        version = f"{number:012d}-{uuid.uuid4().hex[:12]}"
        try:
            make(now).write.parquet(f"{folder.root}/versions/{version}")
            done = folder.publish(f"pointers/{number:012d}", version)
        except Exception:
            folder.delete(f"versions/{version}")
            if _last(folder) >= number + KEPT_VERSIONS - 1:  # so late that it was deleted as old
                continue
            raise
        if done:
            _drop_old(folder, number)
            return number
        folder.delete(f"versions/{version}")  # another writer was first: start again on its version
    raise SourceError(f"the log {root} is being written to all the time")


def _drop_old(folder: _Folder, number: int) -> None:
    for kind in ("pointers", "versions"):  # a pointer goes before its version
        for name in folder.names(kind):
            if int(name.split("-")[0]) <= number - KEPT_VERSIONS:
                folder.delete(f"{kind}/{name}")


def append_and_trim(turns: DataFrame, root: str, keep: int = 200, now: datetime | None = None) -> int:
    """A6 + G2: append answered questions (see ``files.append_turns``) and keep the newest ``keep``
    rows by id, in one step. Returns the new version's number."""
    new = log_rows(turns, now)

    def make(log):
        return C.keep_newest(new if log is None else log.unionByName(new), ["id"], keep)
    return _replace(turns.sparkSession, root, make)


def clear_log(spark: SparkSession, root: str) -> int:
    """The next version has no rows."""
    empty = spark.createDataFrame([], "id long, created_at timestamp, user_msg string, bot_msg string, "
                                      "sentiment string, score double, sources string")
    return _replace(spark, root, lambda log: empty if log is None else log.limit(0))
