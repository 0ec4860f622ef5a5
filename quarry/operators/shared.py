"""The folder that all executors share, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where it is unset (tests), a folder of our own for the session's life."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df with all rows of a key in one task, in as many tasks as a shuffle has, few bytes or not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def settle_by(df: DataFrame, key: str, is_dealt: bool = False) -> DataFrame:
    """settle as a table in buckets of the key: what joins or groups by it, alone or with more columns, moves no rows. is_dealt: df was made
    task by task from a `dealt` one, and its rows kept their key, so that they need not be dealt again."""
    spark, name = df.sparkSession, f"settled_{uuid.uuid4().hex}"
    if not spark.sparkContext.getConf().contains(CO_PARTITION):
        spark.conf.set(CO_PARTITION, "false")  # else a join by the key and more columns deals both sides again
    rows = df if is_dealt else dealt(df, key)
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def settle(df: DataFrame) -> DataFrame:
    """df written into the shared folder and read back: it is made once, and what follows needs no executor that made it."""
    at = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
