"""Helpers that several operators share: table access, cut lineage, a column for missing text."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder that ``spark.checkpoint.dir`` names.

    A reliable checkpoint survives lost executors.  A session that names no folder gets a
    temporary one, which is right only where driver and executors share a machine (local mode);
    on a cluster that is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts and sets are long: Python gets ``rows`` of them at a time (Spark's setting for Arrow batches)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


#: In front of the columns that operators add to whole tables for a while; no table has such names.
OWN = "__llm_"


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number that tells equal rows apart in one reading of ``df``.

    Another reading may cut the files at other places and give other numbers: ``numbered`` is for
    tables that are read again.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


#: The column that ``numbered`` adds.
ROW = f"{OWN}row"
#: Rows of a file have the low bits of the number, files the others.
FILE_BITS = 40


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW``, a number of each row that is the same at every read, however the files are cut.

    In a plain scan of files it is made of the file's place among the sorted paths (a broadcast row
    per file) and the row's index in its file.  Any other table is numbered once and kept in the
    shared folder.  A table that has the column is returned as it is.
    """
    if ROW in df.columns:
        return df
    if not _scans_files(df):
        return cut(with_row(df, ROW))
    place = df.metadataColumn("_metadata")
    path, at, key, number = (f"{OWN}{x}" for x in ("path", "at", "file_path", "file"))
    paths = sorted(x[0] for x in df.select(place["file_path"]).distinct().collect())
    files = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(paths)], f"{key} string, {number} long")
    placed = df.select("*", place["file_path"].alias(path), place["row_index"].alias(at))
    whole = F.shiftleft(F.col(number), FILE_BITS).bitwiseOR(F.col(at))
    return placed.join(F.broadcast(files), F.col(path) == F.col(key)).select(*df.columns, whole.alias(ROW))


def _scans_files(df: DataFrame) -> bool:
    """Whether ``df`` is one scan of files that know their rows' indexes, with projections and filters at most."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        return bool(df.select(df.metadataColumn("_metadata")["row_index"]).columns)
    except AnalysisException:  # a source that is no file, or a format without indexes
        return False
