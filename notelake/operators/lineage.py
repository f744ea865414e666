"""Plans that stay small: intermediate tables held in the plan or written to the shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be sent to all tasks: words, queries, ids, of up to a few hundred bytes each.
SENT_ROWS = 200_000

#: Rows and bytes of a batch's phrases or groups that become part of the plan itself.
HELD_ROWS, HELD_BYTES = 20_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set, in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="notelake-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sent(df: DataFrame) -> DataFrame:
    """A broadcast hint if the frame is counted to have few rows; else the frame as it is, which
    joins by a shuffle. For narrow frames that are cheap to count."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def cut(df: DataFrame) -> DataFrame:
    """The frame computed once and checkpointed in the folder of spark.checkpoint.dir (a temporary
    one only where none is set), so that later plans start from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """The frame computed once: as values in the plan if its rows are few and narrow, which Catalyst
    knows the size of and joins by broadcast; else checkpointed. For what grows with a batch of
    queries, not with the notes."""
    rows = df.limit(HELD_ROWS + 1).toArrow()
    if rows.num_rows > HELD_ROWS or rows.nbytes > HELD_BYTES:
        return cut(df)
    return df.sparkSession.createDataFrame(rows, schema=df.schema)
