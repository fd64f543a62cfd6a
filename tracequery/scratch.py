"""Intermediate tables in the shared checkpoint folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_RECORDS: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is empty a private folder is used, but only in local mode: on a cluster a
    machine-local folder would be invisible to the other machines, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tracequery-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/tracequery/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; the plan starts anew from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables made inside, in order."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that no plan reads any more, through the file system that holds them."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all of the application's tables; DataFrames that were made from them end with them."""
    remove(spark, [f"{scratch_dir(spark)}/tracequery/{spark.sparkContext.applicationId}"])
