"""Tables written to the folder that driver and executors share, and their removal.

A written table ends lineage and survives lost executors. Steps that need many of them write through ``Tables``, which deletes
what the result does not read; the shuffle files of a write go when it is done. What results read stays until ``clean_up``, which is for
when they are written, or until the process ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of durable tables by session, and temporary folders of our own.
_KEPT: list[tuple[SparkSession, str]] = []
_FOLDERS: list[str] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode only; a cluster has to name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        _FOLDERS.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = f"file://{_FOLDERS[-1]}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_once(frame: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write the frame and read the path back; its shuffle files are deleted after the write."""
    spark = frame.sparkSession
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        frame.write.mode(mode).parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)


def durable(frame: DataFrame, name: str) -> DataFrame:
    """A written table that stays until ``clean_up``: for what a result reads."""
    path = new_path(frame.sparkSession, name)
    _KEPT.append((frame.sparkSession, path))
    return write_once(frame, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> int:
    """Delete the durable tables written in this session's application so far, and say how many; frames that read them are of no use afterwards."""
    own = [x for x in _KEPT if x[0].sparkContext is spark.sparkContext]
    for kept in own:
        remove(spark, kept[1])
        _KEPT.remove(kept)
    return len(own)


@atexit.register
def _at_exit() -> None:
    """What is left when the process ends: tables of sessions that still run, and temporary folders of our own."""
    try:
        for session in {id(x[0].sparkContext): x[0] for x in _KEPT}.values():
            if session.sparkContext._jsc is not None:
                clean_up(session)
    finally:
        for folder in _FOLDERS:
            shutil.rmtree(folder, ignore_errors=True)


class Tables:
    """Written tables of one computation; ``drop`` deletes one, leaving the block deletes all."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = write_once(frame, path)
        self.paths[id(out)] = (path, out)
        return out

    def append(self, frame: DataFrame, onto: DataFrame) -> DataFrame:
        """The written table ``onto`` with the frame's rows in it, too."""
        path = self.paths.pop(id(onto))[0]
        out = write_once(frame.select(*onto.columns), path, "append")
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            if id(frame) in self.paths:
                remove(self.spark, self.paths.pop(id(frame))[0])

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(frame for _, frame in list(self.paths.values())))
