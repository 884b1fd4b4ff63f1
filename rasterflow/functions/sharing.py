"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The configured checkpoint folder; one of our own only on a single machine where none is set, as in tests."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (set_already.get() if set_already.isDefined() else None)
    if not found:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not set_already.isDefined():
        sc.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession) -> str:
    """A folder in the shared one that nothing is in."""
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again. Unlike a checkpoint it takes its size from its files: in rounds
    of joins an estimate carried on would be squared in each round, until the planner does nothing but multiply."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to several tasks a core, for work that is heavy beside its bytes: Spark would merge partitions of few bytes into one."""
    return df.repartition(4 * max(1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds name, 1, 2, ... by order: counts of range partitions are summed up, so no task holds all rows."""
    ordered = checkpoint(df.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ordered.join(F.broadcast(before), "part").withColumn(name, place + F.col("before")).drop("part", "before")
