"""Writing tables: plainly, behind checks, or once for several jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import shared_folder

#: The file whose presence says that a stored table is whole.
MARKER = "_STORED"


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Persist a result as Parquet (CREATE TABLE ... AS / INSERT)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _located(spark: SparkSession, path: str):
    """The file system of a path (HDFS, an object store, local disk) and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; one that is not there is no error."""
    fs, at = _located(spark, path)
    fs.delete(at, True)


def publish_checked(df: DataFrame, path: str, metrics: dict[str, Column], accept: Callable[[dict], None],
                    columns: list[str] | None = None) -> dict:
    """Write ``columns`` of ``df`` as Parquet at ``path`` if ``accept`` does not raise.

    The metrics (aggregates over ``df``) are observed while the table is written to a folder beside
    ``path``, so ``df`` is evaluated once.  It is renamed to ``path``, in place of an earlier
    table, only if they are accepted; otherwise nothing is left.  Returns the metrics.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    seen = Observation()
    observed = df.observe(seen, *[m.alias(name) for name, m in metrics.items()])
    fs, at = _located(spark, staging)
    try:
        (observed.select(*columns) if columns else observed).write.parquet(staging)
        values = dict(seen.get)
        accept(values)
        target = _located(spark, path)[1]
        fs.delete(target, True)
        if not fs.rename(at, target):
            raise OSError(f"could not rename {staging} to {path}")
    finally:
        fs.delete(at, True)
    return values


class StoredTable:
    """A table that is written once and read by several jobs, until it is released."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _marker(self):
        return _located(self.spark, f"{self.path}/{MARKER}")

    @property
    def whole(self) -> bool:
        """True once everything is written, until the release."""
        fs, marker = self._marker()
        return fs.exists(marker)

    def write(self, df: DataFrame) -> StoredTable:
        """Store ``df``; a second time is refused.  A write that breaks off leaves no marker, so nobody reads it."""
        df.write.mode("errorifexists").parquet(f"{self.path}/data")
        fs, marker = self._marker()
        fs.create(marker, False).close()
        return self

    def read(self) -> DataFrame:
        if not self.whole:
            raise FileNotFoundError(f"no stored table at {self.path}: not written to its end, or released")
        return self.spark.read.parquet(f"{self.path}/data")

    def release(self) -> None:
        """Delete the table: first the marker, then the rest."""
        fs, marker = self._marker()
        fs.delete(marker, False)
        remove(self.spark, self.path)


def store(df: DataFrame, name: str = "table") -> StoredTable:
    """``df`` computed once and kept in a folder of its own in the cluster's shared folder."""
    spark = df.sparkSession
    return StoredTable(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}").write(df)


@contextmanager
def stored(df: DataFrame, name: str = "table") -> Iterator[DataFrame]:
    """The stored table inside a ``with`` block, at whose end it is released."""
    table = store(df, name)
    try:
        yield table.read()
    finally:
        table.release()
