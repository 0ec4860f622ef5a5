"""Streaming queries, run over the events table as a batch of files or as the batch form of the same plan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators.shared import shared_dir
from quarry.registry import query
from quarry.sources.tables import load
from quarry.streaming import ingest as I


def shared(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def t1_stream_upsert(spark, d):
    at = shared(spark)
    rows = load(spark, d, "events").select("user_id", "event_id", "event_type")
    rows.repartition(4).write.parquet(f"{at}/in")
    I.ingest(I.file_stream(spark, f"{at}/in", rows.schema, 2), ["user_id"], "event_id", f"{at}/out", f"{at}/state", 4).awaitTermination()
    return spark.read.schema("user_id long, event_id long, event_type string, bucket int").parquet(f"{at}/out").select("user_id", "event_id", "event_type")


@query("""WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 3600 THEN 0 ELSE 1 END AS new FROM (SELECT event_id, user_id, epoch(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
  SELECT user_id, floor(min(t))::BIGINT AS start, floor(max(t) + 3600)::BIGINT AS finish, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g) GROUP BY user_id, session""")
def t2_session_windows(spark, d):
    return I.session_counts(load(spark, d, "events"), "user_id", "ts")


@query("SELECT start, count(*) AS n, count(*) / 3600 AS rate FROM (SELECT unnest(range((t // 1800 - 1) * 1800, (t // 1800 + 1) * 1800, 1800)) AS start FROM (SELECT floor(epoch(ts))::BIGINT AS t FROM events)) GROUP BY 1")
def t3_rates(spark, d):
    return I.rates(load(spark, d, "events"), "ts", "3600 seconds", "1800 seconds")


@query("WITH RECURSIVE l AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size % 5 <> 0), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN l ON node = src WHERE depth < (SELECT count(*) FROM part)) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def t8_reachable(spark, d):
    part = load(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    links = part.where("p_size % 5 <> 0").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst"))
    return I.reachable(links, spark.createDataFrame([(1,)], "node long"))
