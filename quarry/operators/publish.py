"""Several tables changed together or not at all, with the numbers of rows written.

A version is a folder of its own; its tables are written there first, and it becomes the current one by renaming one manifest over the old. A job
that fails before that leaves readers with the old version of every table; a reader opens the manifest once and so sees one version of all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "CURRENT.json"


def _files(spark: SparkSession, at: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    return jvm, path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, at: str) -> str | None:
    jvm, path, files = _files(spark, at)
    if not files.util().exists(path):
        return None
    stream = files.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _rename_over(spark: SparkSession, text: str, at: str) -> None:
    """text becomes the content of `at`, which has either its old content or all of the new."""
    aside = f"{at}.{uuid.uuid4().hex}"
    jvm, path, files = _files(spark, aside)
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE, jvm.org.apache.hadoop.fs.CreateFlag.OVERWRITE)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    out = files.create(path, flags, none)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files.rename(path, jvm.org.apache.hadoop.fs.Path(at), over)


def manifest(spark: SparkSession, root: str) -> dict:
    """{version, tables: {name: {path, rows}}} of the current version; no tables before the first."""
    found = _read(spark, f"{root}/{MANIFEST}")
    return json.loads(found) if found else {"version": None, "tables": {}}


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, int]:
    """Replaces these tables of root in one step; others stay as they are. Returns the number of rows of each, counted as they are written. One publisher at a time."""
    version = uuid.uuid4().hex
    now = manifest(spark, root)["tables"]
    for name, df in tables.items():
        rows, at = Observation(f"{name}-{version}"), f"{root}/{version}/{name}"
        df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(at)
        now[name] = {"path": at, "rows": rows.get["rows"]}
    _rename_over(spark, json.dumps({"version": version, "tables": now}), f"{root}/{MANIFEST}")
    return {name: now[name]["rows"] for name in tables}


def published(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    """These tables, all of one version."""
    tables = manifest(spark, root)["tables"]
    return [spark.read.parquet(tables[n]["path"]) for n in names]


def rebuild(spark: SparkSession, root: str, sources: dict[str, DataFrame], derive: dict) -> dict[str, int]:
    """Every derived table made anew from the sources (name -> function of the sources), and published together."""
    return publish(spark, root, {name: make(sources) for name, make in derive.items()})


def set_where(df: DataFrame, where: Column, column: str, value: Column) -> tuple[DataFrame, Observation]:
    """K9: df with `column` set where the condition holds, and the number of rows changed, known (`.get["changed"]`) once df has been written."""
    changed, hit = Observation(f"changed-{uuid.uuid4().hex}"), F.coalesce(where, F.lit(False))
    out = df.withColumn("_hit", hit).observe(changed, F.count_if("_hit").alias("changed"))
    return out.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit"), changed
