"""Streams: files of log rows ingested once each, sessions and rates with watermarks, and link reachability by frontiers."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.merge import last_wins
from quarry.operators.shared import settle


def file_stream(spark: SparkSession, path: str, schema, per_batch: int = 100) -> DataFrame:
    """New Parquet files under path, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def ingest(stream: DataFrame, keys: list[str], seq: str, target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Rows upserted into Parquet partitions by a hash of their key; the newest by seq stays. A batch rewrites only the buckets it touches, and a
    batch that is run again gives the same table."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        old = spark.read.schema(fresh.schema).parquet(target).where(F.col("bucket").isin(touched)) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
        merged = last_wins(fresh if old is None else old.unionByName(fresh), [*keys, "bucket"], seq)
        # the old files are read while the partitions are replaced, so the rows are written aside first
        aside = f"{checkpoint}/merged"
        merged.write.mode("overwrite").parquet(aside)
        spark.read.schema(merged.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


def session_counts(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sessions that end after `gap` without events. On a stream, append mode gives those the watermark has closed."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.session_window("_at", gap)
    out = timed.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.unix_seconds("w.start").alias("start"), (F.unix_seconds("w.end")).alias("finish"), "events")


def rates(events: DataFrame, at: str, span: str = "60 seconds", step: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Events a second in sliding windows."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    w = F.window("_at", span, step)
    out = timed.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return out.select(F.unix_seconds("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))


def reachable(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Node, depth of all nodes that links (src, dst) reach from seeds (node), by breadth-first frontiers until one is empty. Each step is an anti-join; what is
    known is written to the shared folder so that the plan stays short."""
    spark = links.sparkSession
    known = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = known
    for step in itertools.count(1):
        frontier = settle(frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
        if step % 10 == 0:  # else a long chain makes a union of as many tables
            known = settle(known.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return known
