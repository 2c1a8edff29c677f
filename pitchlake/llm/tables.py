"""Small helpers shared by the operators: intermediate tables, row numbers and input columns."""

from __future__ import annotations

import gc

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again, so that later steps and lost executors reread them.

    What the step shuffled isn't needed any more. Spark frees it when the driver collects its garbage, which may be
    long after the disks are full, so that is asked for here.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column name in backquotes, so that dots in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def documents_of(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text: other columns, whatever their names, can't clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` without the rows named in `rows` (doc_id, text_key = xxhash64(text)); all columns stay as they are."""
    gone = rows.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left_anti")


class RowNumbers:
    """Numbers for the rows that a task sees, unique over all tasks of one stage."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 40

    def take(self, n: int) -> range:
        self.next += n
        return range(self.next - n, self.next)
