"""Cutting long plans through files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; without it, only a local session may go on."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="linkloom-checkpoint-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows read back from the checkpoint folder, without their lineage.

    Spark removes the files of frames that are no longer referenced when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with the file system that its path belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Whether Spark removes the shuffle files of a query as it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files.

    Otherwise they stay until the driver happens to collect its garbage, and those of a long job add up.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


class Scratch:
    """Tables that a job writes for its own use; they are removed when it ends.

    ``with Scratch(spark) as scratch: rows = scratch.keep(frame)``. Nothing that
    reads them may be used after the block.
    """

    def __init__(self, spark: SparkSession, **options: str):
        """``options``: those of the writer."""
        self._spark, self._folder, self._n, self._options = spark, shared_folder(spark, "scratch"), 0, options

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self._spark, self._folder)

    def keep(self, frame: DataFrame) -> DataFrame:
        """The rows of ``frame``, written once and read back."""
        path = f"{self._folder}/{self._n}"
        self._n += 1
        with freed_shuffles(self._spark):
            frame.write.options(**self._options).parquet(path)
        return self._spark.read.schema(frame.schema).parquet(path)
