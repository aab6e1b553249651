"""Session and durability helpers shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session within one machine (``local``, ``local[...]``) gets a
    folder of its own beside its scratch files; on a cluster no such folder can be read by
    all executors, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    scratch = spark.conf.get("spark.local.dir", None) or spark._jvm.java.lang.System.getProperty("java.io.tmpdir")
    return f"{scratch.split(',')[0]}/millrace-checkpoint-{context.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through files every executor can read.

    Losing an executor afterwards costs nothing, because the rows are read back from the
    files. They are removed with the last reference to them where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder, which is set if it isn't yet."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_folder(spark))
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def exchange(spark: SparkSession) -> Iterator[str]:
    """A folder beside the checkpoints, for what Python of tasks and driver hand each other past the driver's JVM; it goes at the end."""
    uri = re.sub("^file:/+", "file:///", f"{_checkpoints(spark)}/{uuid4().hex}")
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path)
    try:
        yield uri
    finally:
        files.delete_dir(path)


def put(folder: str, data: np.ndarray) -> str:
    """The name of a new file of ``folder`` with the numbers of ``data``; a task that is run twice writes two."""
    uri = f"{folder}/{uuid4().hex}"
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(data).view(np.uint8).data)
    return uri


def take(uri: str, width: int) -> np.ndarray:
    """The numbers of a file as rows of ``width``."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as data:
        return np.frombuffer(data.read()).reshape(-1, width)


def forget(uris: list[str]) -> None:
    """Removes files."""
    for uri in uris:
        files, path = fs.FileSystem.from_uri(uri)
        files.delete_file(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside sends at most ``rows`` rows at a time to Python: rows of long lists fill several buffers of each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
