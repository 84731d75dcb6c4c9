"""Paths and tables shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROW_GROUP = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is used as the session names it.  Where it is
    unset, a local session (tests) gets a temporary folder of its own and a
    cluster session gets a folder in its warehouse, which all nodes reach.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="pointspan-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pointspan"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage in a way that survives lost executors, and gives
    every later use the same rows without computing them again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    # Small row groups, as a task's writer holds one in memory.
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
