"""What the operators share: tables, checkpoints, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``, read by Spark alone, so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new local one, which only a local master may use."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to a table in the shared folder: lineage ends there and lost executors cost nothing.

    Shuffle files behind the rows go once they are written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "cut")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, by the file system that it is on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind frames from ``cut`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            remove(df.sparkSession, path)


def ordered(df: DataFrame) -> DataFrame:
    """The rows in a checkpoint, which keeps the order of rows and partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def join_hot(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, a row per key that was aggregated from it, where a key may be very common.

    The join has a second key that follows from the first, so that ``one`` is shuffled again for the
    join itself: adaptive execution splits hot keys only between two such shuffles.
    """
    also = F.pmod(F.hash(key), F.lit(1 << 20))
    return many.withColumn("__also", also).join(one.withColumn("__also", also), [key, "__also"], how).drop("__also")


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def id_type(df: DataFrame, col: str) -> str:
    """The type of an id column, for the schemas of functions that hand ids on as they are."""
    return dict(df.dtypes)[col]


def numbered(df: DataFrame, col: str) -> DataFrame:
    """(id, number) of the distinct ids that are not null; numbers are long and in the order of the ids."""
    distinct = df.where(F.col(col).isNotNull()).select(F.col(col).alias("id")).distinct()
    return cut(ordered(distinct.orderBy("id")).withColumn("number", F.monotonically_increasing_id()))


class TooLarge(ValueError):
    """What was to be broadcast is over its bound."""


def collect_bounded(df: DataFrame, rows: int) -> list:
    """The rows of a table with a proven bound; raises TooLarge rather than dropping any."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise TooLarge(f"over {rows} rows")
    return got
