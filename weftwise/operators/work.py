"""Intermediate tables in the folder that the cluster shares: lineage ends there, and lost executors cost one step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.sources.settings import Settings


def shared_folder(df: DataFrame) -> str:
    """The folder of the settings; only where none is set and all runs in one process a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = Settings.of(spark).checkpoint_dir or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weftwise-"))
        folder = context.getCheckpointDir()
    return folder


#: Written tables of more bytes are never sent to all tasks by way of the driver.
SENT_TO_ALL = 256 * 1024


#: Rows that a task sorts or groups at a time, however large the table.
ROWS_A_TASK = 150_000

#: Tables of up to so many parts are left to Spark's own shuffles.
FEW_PARTS = 4

#: Tables of up to so many rows are sent to all tasks.
FEW = 10_000


def parts_of(rows: int) -> int:
    """Into how many parts so many rows are dealt before they are sorted or grouped."""
    return -(-rows // ROWS_A_TASK)


def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` in ``n`` parts by key.

    Spark merges the parts of its own shuffles by their compressed bytes, so rows that compress well meet in a few
    tasks, and these grow with the table. Parts whose number was given stay as they are (a join may make more of them).
    """
    return df.repartition(n, *by) if n > FEW_PARTS else df


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, for joins that send it to all tasks if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a table that was written once; it goes when the session's JVM ends.

    Files of repeated keys and names are many times smaller than their rows are in memory, so Spark, which goes by the
    files, would broadcast tables that the driver has no room for. Beyond ``SENT_TO_ALL`` joins with it are sort-merge joins.
    """
    path = f"{shared_folder(df)}/weftwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    made = spark.read.schema(df.schema).parquet(path)
    return made.hint("merge") if files.getContentSummary(where).getLength() > SENT_TO_ALL else made
