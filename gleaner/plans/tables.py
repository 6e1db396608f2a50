"""Intermediate tables in the shared folder, and joins that stay safe when a key is hot."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in spark.checkpoint.dir.

    A local session without the setting gets a folder of its own; a cluster session
    without it is an error, since a machine-local folder would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, fixes values that depend on
    the partitioning, and gives Catalyst the true size, so it broadcasts only small tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.written_to = path
    return stored


def forget(stored: DataFrame) -> None:
    """Delete the files of a table made by written, which no later job may read."""
    spark, path = stored.sparkSession, stored.sparkSession._jvm.org.apache.hadoop.fs.Path(stored.written_to)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that nothing refers to any more; else they stay until the driver runs short of heap."""
    gc.collect()
    spark._jvm.System.gc()


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on keys where null equals null; keeps the left copy of the keys."""
    keys = list(keys)
    twins = right.select([F.col(f"`{c}`").alias(f"__r_{c}" if c in keys else c) for c in right.columns])
    on = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in keys])
    return left.join(twins, on, how).drop(*[f"__r_{k}" for k in keys])


def with_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """df with the columns of facts, a table of one row, read as a scalar subquery rather than joined."""
    row = facts.select(F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("s")).scalar()
    wide = df.withColumn("__facts", row)
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], "__facts.*")
