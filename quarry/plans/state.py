"""State over time: conversations, queues, published tables and the log; and the ranked answers that are grouped by drawing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import answers, fts, logs, publish
from quarry.operators.shared import settle, shared_dir
from quarry.plans.pages import said
from quarry.registry import query
from quarry.sources.tables import load
from quarry.streaming import conversations as C
from quarry.streaming import journal


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# T4: a call for each turn of a conversation, what it says taken from the turn's number and text
CALL_SQL = """SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, CASE WHEN n % 5 = 0 THEN 'user' WHEN n % 3 = 0 THEN 'find' WHEN n % 3 = 1 THEN 'search' ELSE 'choose' END AS kind,
  CASE WHEN n % 4 > 0 THEN 'brand ' || n % 2 END AS brand, n % 8 < 5 AS declared, n % 11 = 0 AS another, CASE WHEN n % 2 = 0 THEN 'S' || n % 3 END AS serial, CASE WHEN n % 5 > 1 THEN 'agro ' || n % 2 * 40 + 75 END AS model,
  CASE WHEN n % 7 > 1 THEN 'Agro ' || n % 2 * 40 + 75 END AS selected, n % 6 = 0 AS uncertain FROM (SELECT *, length(text) + turn AS n FROM conversations)"""


@query(f"""WITH RECURSIVE c AS ({CALL_SQL}),
  s AS (SELECT conv, 0::BIGINT AS seq, NULL::VARCHAR AS brand, NULL::VARCHAR AS serial, NULL::VARCHAR AS model, false AS waiting, false AS blocked, false AS brand_sure FROM c WHERE seq = 1
    UNION ALL SELECT conv, seq, CASE WHEN kind <> 'find' THEN old_brand WHEN cb IS NOT NULL AND declared THEN cb ELSE kept_brand END,
      CASE WHEN changed THEN NULL WHEN kind = 'find' AND selected IS NOT NULL THEN coalesce(cs, kept_serial) ELSE kept_serial END,
      CASE WHEN changed THEN NULL WHEN (kind = 'find' OR (kind = 'choose' AND NOT was)) AND selected IS NOT NULL THEN selected ELSE kept_model END,
      CASE kind WHEN 'user' THEN false WHEN 'find' THEN uncertain ELSE was END, kind IN ('choose', 'search') AND was OR changed, kind = 'find' AND cb IS NOT NULL AND (declared OR coalesce(cb = kept_brand, false))
    FROM (SELECT *, coalesce(kind = 'search' AND NOT was AND (cs <> old_serial OR regexp_extract(cm, '[0-9]+') <> regexp_extract(old_model, '[0-9]+')), kind = 'search' AND NOT was AND coalesce(cs <> old_serial, false) OR (kind = 'search' AND NOT was AND coalesce(regexp_extract(cm, '[0-9]+') <> regexp_extract(old_model, '[0-9]+'), false))) AS changed FROM (
      SELECT c.conv, c.seq, c.kind, c.brand AS cb, c.serial AS cs, c.model AS cm, c.declared, c.selected, c.uncertain, s.brand AS old_brand, s.serial AS old_serial, s.model AS old_model, s.waiting AS was,
        CASE WHEN c.kind = 'find' AND c.another THEN NULL ELSE s.brand END AS kept_brand, CASE WHEN c.kind = 'find' AND c.another THEN NULL ELSE s.serial END AS kept_serial, CASE WHEN c.kind = 'find' AND c.another THEN NULL ELSE s.model END AS kept_model
      FROM s JOIN c ON c.conv = s.conv AND c.seq = s.seq + 1)))
  SELECT * FROM s WHERE seq > 0""")
def t4_call_states(spark, d):
    turns = load(spark, d, "conversations")
    n = F.col("n")
    agro = lambda name: said(f"{name} ", n % 2 * 40 + 75)
    calls = turns.withColumn("n", F.length("text") + F.col("turn")).select(
        F.col("conv_id").alias("conv"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("seq"),
        F.when(n % 5 == 0, "user").when(n % 3 == 0, "find").when(n % 3 == 1, "search").otherwise("choose").alias("kind"), F.when(n % 4 > 0, said("brand ", n % 2)).alias("brand"),
        (n % 8 < 5).alias("declared"), (n % 11 == 0).alias("another"), F.when(n % 2 == 0, said("s-", n % 3)).alias("serial"), F.when(n % 5 > 1, agro("agro")).alias("model"),
        F.when(n % 7 > 1, agro("Agro")).alias("selected"), (n % 6 == 0).alias("uncertain"),
    )
    return C.call_states(calls)


# A queue a user; an event fails as often as its number says, errors always
@query("""WITH e AS (SELECT user_id AS queue, event_id AS item, CASE WHEN event_type = 'error' THEN 4 ELSE event_id % 4 + 1 END AS won FROM events),
  t AS (SELECT *, unnest(range(1, least(won, 3) + 1)) AS attempt FROM e)
  SELECT queue, item, attempt::INT AS attempt, row_number() OVER (PARTITION BY queue ORDER BY attempt, item) - 1 AS position, attempt = won AS ok, CASE WHEN won <= 3 THEN 'done' ELSE 'failed' END AS state FROM t""")
def t6_queue_order(spark, d):
    e = load(spark, d, "events")
    items = e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("item"), F.col("event_id").alias("at"))
    tries = e.select(F.col("event_id").alias("item"), "event_type", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    return logs.queue_order(items, tries.select("item", "attempt", ((F.col("event_type") != "error") & (F.col("attempt") > F.col("item") % 4)).alias("ok")))


@query("SELECT 'types' AS name, count(DISTINCT p_type) AS rows FROM part UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def k7_published(spark, d):
    """Two versions of three tables; the manifest's counts are those of the last."""
    root, part = folder(spark, "k7"), load(spark, d, "part")
    publish.publish(spark, root, {"parts": part.limit(1), "suppliers": load(spark, d, "supplier")})
    publish.publish(spark, root, {"types": part.select("p_type").distinct(), "parts": part})
    found = publish.manifest(spark, root)["tables"]
    return spark.createDataFrame([(name, t["rows"]) for name, t in found.items()], "name string, rows long")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS changed FROM orders")
def k9_status_update(spark, d):
    out, changed = publish.set_where(load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), F.col("status") == "P", "status", F.lit(None).cast("string"))
    out = settle(out)
    return out.withColumn("changed", F.lit(changed.get["changed"]))


@query("SELECT 'by brand' AS made, p_brand AS key, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY p_brand UNION ALL SELECT 'by type', p_type, count(*), round(sum(p_retailprice), 2) FROM part GROUP BY p_type")
def k11_published_rebuild(spark, d):
    root = folder(spark, "k11")
    total = lambda c: lambda s: s["part"].groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    publish.rebuild(spark, root, {"part": load(spark, d, "part")}, {"brands": total("p_brand"), "types": total("p_type")})
    brands, types = publish.published(spark, root, "brands", "types")
    return brands.select(F.lit("by brand").alias("made"), "*").union(types.select(F.lit("by type").alias("made"), "*"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'arguments is no JSON' WHEN event_id % 5 = 0 THEN 'unknown role' END AS problem, CASE WHEN event_id % 7 > 0 THEN (props::JSON ->> 'k')::BIGINT END AS k FROM events""")
def k15_log_writer(spark, d):
    at, e = folder(spark, "k15"), F.col("event_id")
    rows = load(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("session"), F.when(e % 5 == 0, "?").otherwise("tool").alias("role"), F.when(e % 7 == 0, F.concat("props", F.lit("{"))).otherwise(F.col("props")).alias("arguments"))
    rows = rows.withColumn("role", F.when(e % 7 == 0, "tool").otherwise(F.col("role")))
    schema = "event_id long, session string, role string, arguments string"
    rows.repartition(4).write.parquet(f"{at}/in")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    journal.journal(files, f"{at}/out", f"{at}/state", ["arguments"]).awaitTermination()
    good, bad = journal.logged(spark, f"{at}/out", schema), journal.set_aside(spark, f"{at}/out", schema)
    both = good.withColumn("problem", F.lit(None).cast("string")).select("event_id", "problem", "arguments").union(bad.select("event_id", "problem", "arguments"))
    return both.select("event_id", "problem", F.when(e % 7 > 0, F.get_json_object("arguments", "$.k").cast("long")).alias("k"))


# Every pair of two words that a part's name and type hold is asked for; a hit's rows are the lines of orders with that part
ROWS_SQL = """t AS (SELECT p_partkey AS doc, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS t FROM part), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
  p AS (SELECT doc, token, count(*) AS tf, any_value(length) AS length FROM (SELECT doc, len(t) AS length, unnest(t) AS token FROM t) GROUP BY doc, token),
  q AS (SELECT DISTINCT lower(p_name) AS query FROM part), qt AS (SELECT query, unnest(string_split(query, ' ')) AS prefix FROM q),
  h AS (SELECT prefix, doc, sum(tf) AS tf, any_value(length) AS length FROM (SELECT DISTINCT prefix FROM qt) JOIN p ON starts_with(token, prefix) GROUP BY ALL), df AS (SELECT prefix, count(*) AS df FROM h GROUP BY 1),
  s AS (SELECT query, doc, count(*) AS met, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM qt JOIN h USING (prefix) JOIN df USING (prefix), st GROUP BY ALL),
  l AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row FROM lineitem),
  j AS (SELECT query, row, round(score, 6) AS score, l_orderkey AS drawing, l_linenumber AS position, l_partkey AS code, l_quantity AS quantity, o_orderstatus AS status, o_orderpriority AS title FROM s JOIN l ON l_partkey = doc JOIN orders ON o_orderkey = l_orderkey WHERE met = len(string_split(query, ' ')))"""


def ranked(spark, d):
    part = load(spark, d, "part")
    asked = part.select(F.lower("p_name").alias("query")).distinct().select("query", F.col("query").alias("text"))
    found = fts.search_texts(part.withColumn("said", F.concat("p_name", F.lit(" "), "p_type")), "p_partkey", "said", asked).select("query", F.col("doc").alias("code"), F.round("score", 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = load(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + place).alias("row"), F.col("l_orderkey").alias("drawing"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("quantity"))
    drawings = load(spark, d, "orders").select(F.col("o_orderkey").alias("drawing"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"))
    return found.join(rows.select("row", "code"), "code").select("query", "row", "score"), rows, drawings


@query(f"WITH {ROWS_SQL} SELECT query, row, score, drawing, position, code, status FROM j")
def j5_ranked_rows(spark, d):
    return answers.ranked_rows(*ranked(spark, d)).select("query", "row", "score", "drawing", "position", "code", "status")


@query(f"WITH {ROWS_SQL} SELECT query, row_number() OVER w::INT AS place, row, score, drawing, code FROM j WHERE status = 'F' AND quantity > 45 WINDOW w AS (PARTITION BY query ORDER BY score DESC, row) QUALIFY place <= 20")
def o7_top_under_filter(spark, d):
    scored, rows, drawings = ranked(spark, d)
    found = answers.top_under_filter(scored, rows.join(drawings, "drawing"), "row", (F.col("status") == "F") & (F.col("quantity") > 45), 20)
    return found.select("query", "place", "row", "score", "drawing", "code")


@query(f"""WITH {ROWS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS place FROM j WHERE status <> 'P' QUALIFY place <= 60),
  g AS (SELECT query, drawing, min(place) AS first, any_value(title) AS title, drawing % 50 AS grp, drawing % 7 AS number FROM f GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grp, number, first) AS block FROM g),
  w AS (SELECT query, string_agg(title || '=' || n, ',' ORDER BY title) AS variants FROM (SELECT query, title, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1) GROUP BY 1), k AS (SELECT query, count(DISTINCT code) AS total_codes FROM f GROUP BY 1)
  SELECT f.query, block::INT AS block, row_number() OVER (PARTITION BY f.query, block ORDER BY place)::INT AS rank, 'GROUP ' || grp || ' DRAWING ' || number || ' - ' || b.title AS context, f.code, total_codes, variants IS NOT NULL AS ambiguous, coalesce(variants, '') AS variants
  FROM f JOIN b USING (query, drawing) JOIN k USING (query) LEFT JOIN w USING (query) WHERE block <= 10 QUALIFY rank <= 12""")
def x13_grouped_answer(spark, d):
    scored, rows, drawings = ranked(spark, d)
    found = answers.top_under_filter(scored, rows.join(drawings, "drawing"), "row", F.col("status") != "P", 60)
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    hits = found.select("query", "place", F.lit("all").alias("catalog"), "drawing", text(F.col("drawing") % 50).alias("grp"), text(F.col("drawing") % 7).alias("number"), F.concat("title", F.lit(" / x")).alias("title"), none.alias("valid_from"), none.alias("valid_to"), text(F.col("position")).alias("position"), "code", none.alias("description"))
    told = F.array_join(F.transform("variants", lambda v: F.concat(v["title"], F.lit("="), v["n"].cast("string"))), ",")
    return answers.grouped_answer(hits).select("query", "block", "rank", "context", "code", "total_codes", "ambiguous", F.coalesce(told, F.lit("")).alias("variants"))
