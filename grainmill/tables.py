"""Intermediate tables in the folder that driver and executors share, and the dealing out of small scans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
_collectors: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="grainmill-")
        _written.append((spark, _own[app]))
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/grainmill/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    for paths in _collectors:
        paths.append(path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    fs, found = hadoop_path(spark, path)
    fs.delete(found, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before
            return


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage, survives lost executors and has a known size."""
    path, schema = new_path(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._grainmill_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again."""
    delete(df.sparkSession, df._grainmill_path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are made inside the block, so that they can be deleted when nothing reads them any more."""
    paths: list[str] = []
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.remove(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it has fewer partitions than the cluster has cores; a large scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
