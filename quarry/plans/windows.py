"""Order-sensitive queries and the batch form of log queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import logs as L
from quarry.registry import query
from quarry.sources.tables import CATALOG_SQL, catalog_view, load

def _seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


@query(f"WITH {CATALOG_SQL} SELECT drawing, code, position, n FROM (SELECT drawing, code, position, row_number() OVER (PARTITION BY drawing ORDER BY position, code, quantity)::INT AS n FROM v) WHERE n <= 3")
def w1_first_per_group(spark, d):
    w = Window.partitionBy("drawing").orderBy("position", "code", "quantity")
    return catalog_view(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("drawing", "code", "position", "n")


@query(f"""WITH {CATALOG_SQL}, f AS (SELECT DISTINCT drawing, position AS p FROM v WHERE grp = 'PROMO'), x AS (SELECT v.drawing, v.code, v.position, min(abs(v.position - f.p)) AS far FROM v JOIN f USING (drawing) WHERE grp <> 'PROMO' GROUP BY ALL)
  SELECT drawing, code, position, far FROM (SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY far, position, code) AS n FROM x) WHERE n <= 2""")
def w2_nearest_positions(spark, d):
    rows = catalog_view(spark, d)
    found = rows.where("grp = 'PROMO'").groupBy("drawing").agg(F.collect_set("position").alias("ps"))  # positions of one drawing
    other = rows.where("grp <> 'PROMO'").select("drawing", "code", "position").distinct().join(found, "drawing")
    far = F.array_min(F.transform("ps", lambda p: F.abs(F.col("position") - p)))
    w = Window.partitionBy("drawing").orderBy("far", "position", "code")
    return other.withColumn("far", far).withColumn("n", F.row_number().over(w)).where("n <= 2").select("drawing", "code", "position", "far")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def w3_carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("heading"))


@query("SELECT user_id, island, string_agg(event_type, ' ' ORDER BY event_id) AS description FROM (SELECT *, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM events) GROUP BY 1, 2")
def w4_continued_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, d, "events").withColumn("island", F.sum((F.col("event_type") == "view").cast("long")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return rows.groupBy("user_id", "island").agg(F.array_join(F.transform(parts, lambda x: x["event_type"]), " ").alias("description"))


@query("SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def w5_keep_first(spark, d):
    return load(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system'), k AS (SELECT * FROM r WHERE n <= 4), c AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS cut FROM k GROUP BY 1)
  SELECT conv_id, turn, role FROM conversations WHERE role = 'system' UNION ALL SELECT k.conv_id, turn, role FROM k JOIN c USING (conv_id) WHERE turn >= cut""")
def w6_truncated_conversation(spark, d):
    return L.last_turns(load(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", 4)


@query("SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 3 GROUP BY 1")
def w7_last_user_messages(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = load(spark, d, "conversations").where("role = 'user'").withColumn("n", F.row_number().over(w)).where("n <= 3")
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("turn")).cast("array<string>"), ",").alias("turns"))


@query("WITH s AS (SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY 1), n AS (SELECT floor(epoch(max(ts)))::BIGINT AS now FROM events) SELECT user_id, last FROM s, n WHERE now - last <= 86400 ORDER BY last DESC, user_id LIMIT 50")
def w8_session_eviction(spark, d):
    sessions = load(spark, d, "events").groupBy("user_id").agg(F.max(_seconds()).alias("last"))
    now = sessions.agg(F.max("last").alias("now"))
    return L.evict(sessions.crossJoin(F.broadcast(now)), "user_id", F.col("last"), F.col("now"), 86400, 50).select("user_id", "last")


@query("SELECT event_id, round(CASE WHEN n < 2 THEN 0 ELSE n / greatest(1.0, t - o) END, 9)::DOUBLE AS rate FROM (SELECT event_id, t, count(*) OVER w AS n, min(t) OVER w AS o FROM (SELECT event_id, user_id, epoch(ts)::BIGINT AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"))
def w9_rolling_rate(spark, d):
    return L.rolling_rate(load(spark, d, "events"), ["user_id"], _seconds(), 3600).select("event_id", F.round("rate", 9).alias("rate"))


@query("""WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events), r AS (SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY event_id)::BIGINT AS run FROM i)
  SELECT event_id, run, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, greatest(run, 1) + 1), lambda x: 1.0::DOUBLE)), lambda d, x: least(0.4, d * 1.5 + 0.05)), 9)::DOUBLE AS wait FROM r""")
def w10_failures_and_backoff(spark, d):
    runs = L.failure_runs(load(spark, d, "events"), "user_id", ["event_id"], F.col("event_type") == "error")
    return runs.select("event_id", "run", F.round(L.backoff(F.col("run"), 0.4), 9).alias("wait"))


@query("SELECT p_brand, best, count(*) > 1 AS ask FROM (SELECT p_brand, p_size, max(p_size) OVER (PARTITION BY p_brand) AS best FROM part) WHERE p_size = best GROUP BY 1, 2")
def w11_tie_at_best(spark, d):
    part = load(spark, d, "part")
    best = part.groupBy("p_brand").agg(F.max("p_size").alias("best"))
    return part.join(best, "p_brand").where("p_size = best").groupBy("p_brand", "best").agg((F.count(F.lit(1)) > 1).alias("ask"))


@query("SELECT l_orderkey, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page FROM lineitem GROUP BY 1")
def w12_page_span(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_page"), F.max("l_linenumber").alias("last_page"))


@query("""WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
  SELECT user_id, session, count(*) AS events, min(t) AS start, max(t) AS finish FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS session FROM g) GROUP BY 1, 2""")
def t2_idle_sessions(spark, d):
    rows = L.idle_sessions(load(spark, d, "events"), "user_id", _seconds(), 3600)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("_t").alias("start"), F.max("_t").alias("finish"))


@query("SELECT user_id, start, count(*) AS requests FROM (SELECT user_id, unnest(range((t // 1800 - 1) * 1800, (t // 1800 + 1) * 1800, 1800)) AS start FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events)) GROUP BY 1, 2")
def t3_sliding_rate(spark, d):
    rows = load(spark, d, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "3600 seconds", "1800 seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return rows.select("user_id", F.unix_seconds("w.start").alias("start"), "requests")


@query("SELECT user_id, count(*) AS attempts, max_by(event_type, event_id) AS final_state, count_if(event_type = 'error') >= 3 AS given_up FROM events GROUP BY 1")
def t6_retry_queue(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("event_type", "event_id").alias("final_state"), (F.count_if(F.col("event_type") == "error") >= 3).alias("given_up"))


@query("SELECT event_id, gap FROM (SELECT event_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events)) WHERE gap > 36000")
def t7_inactivity(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    return load(spark, d, "events").select("event_id", "user_id", _seconds().alias("t")).withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap > 36000").select("event_id", "gap")


@query("SELECT conv_id, bool_or(asks) AS changed, sum(asks::INT)::BIGINT AS n, max(turn) FILTER (asks) AS last FROM (SELECT conv_id, turn, role = 'user' AND length(text) > 200 AS asks FROM conversations) GROUP BY 1")
def t4_conversation_state(spark, d):
    asks = (F.col("role") == "user") & (F.length("text") > 200)
    return load(spark, d, "conversations").withColumn("asks", asks).groupBy("conv_id").agg(F.bool_or("asks").alias("changed"), F.sum(F.col("asks").cast("long")).alias("n"), F.max(F.when(F.col("asks"), F.col("turn"))).alias("last"))


@query("SELECT p_partkey, regexp_extract(p_name, '^[a-z]+') AS word, p_size // 2 AS half FROM part")
def f39_scalar_functions(spark, d):
    return load(spark, d, "part").select("p_partkey", F.regexp_extract("p_name", "^[a-z]+", 0).alias("word"), F.expr("p_size div 2").cast("int").alias("half"))
