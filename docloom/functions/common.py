"""Small helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """The text without white space of any kind at both ends; null stays null."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Of the rows with the same key, one with the latest time.

    Rows of one key and equal time are taken to be equal; a null time is older than any other. The rank filter lets
    Spark cut each key to one row before the shuffle, so a key that holds a third of the rows does no harm. Set
    columns that are only wanted on some rows to null beforehand: they are shuffled.
    """
    rank = "__rank"
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the session (``spark.checkpoint.dir``).

    A session with a local master that names no folder gets a temporary one; on a cluster a machine's own folder would
    be of no use to the other machines, so there the setting must be given.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Remove the checkpoints that these frames read, once what was made of them has a checkpoint of its own."""
    seen = set()
    for df in frames:
        leaves = df._jdf.queryExecution().logical().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName() != "LogicalRDD":
                continue
            file = leaf.rdd().getCheckpointFile()
            if file.isDefined() and file.get() not in seen:
                seen.add(file.get())
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
