"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Sizes of Arrow batches of texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold a thousand rows, unless the session sets a size of its own.  Batches of
    whole texts are held several times over on both sides of the crossing; with the default of 10,000 rows that is
    most of what a worker needs."""
    conf = df.sparkSession.conf
    for key, size in BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, size)
    return df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset, a local folder for a session that runs in one process (tests, a
    laptop), and an error for a cluster, whose machines would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            given = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.getFileStatus(target).isDirectory()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for tables that a lazy result still reads; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, target = _at(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of any file system, there whole or not at all."""
    fs, target = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, target)


def read_texts(spark: SparkSession, folder: str, suffix: str) -> dict[str, str]:
    """Names and contents of the small files of a folder whose names end so; none if the folder is not there."""
    fs, target = _at(spark, folder)
    if not fs.exists(target):
        return {}
    found = {}
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.endswith(suffix):
            stream = fs.open(status.getPath())
            found[name] = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            stream.close()
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that the session knows."""
    fs, target = _at(spark, path)
    fs.delete(target, True)
