"""The folder that driver and executors share, and the tables that operators store there on their way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own does for a local master only, as
    executors of a cluster don't see the driver's folders."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return named or sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it ends, as nothing reads them again."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.set(option, before)


#: Paths of the tables that are stored inside :func:`noted`; each thread and task has its own.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that operators store inside, in the order they are written. Results read from these tables
    when they are evaluated, so :func:`discard` them once such a result is written elsewhere."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def note(path: str) -> None:
    """Says that a table was stored."""
    if (paths := _NOTED.get()) is not None:
        paths.append(path)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes stored tables."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
