"""Upserts, ledgers and other maintenance, on two versions of a table made from its keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import merge as M
from quarry.registry import query
from quarry.sources.tables import load

VERSIONS_SQL = "(SELECT p_partkey % 500 AS k, p_partkey AS seq, p_name AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size, p_partkey % 2 AS side FROM part)"


def versions(spark, d):
    return load(spark, d, "part").select((F.col("p_partkey") % 500).alias("k"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"), (F.col("p_partkey") % 2).alias("side"))


@query(f"SELECT k, max(seq) AS seq, max_by(name, seq) AS name FROM {VERSIONS_SQL} GROUP BY k")
def k1_last_wins(spark, d):
    return M.last_wins(versions(spark, d).select("k", "seq", "name"), ["k"], "seq")


@query(f"SELECT k, min(seq) AS seq, min_by(name, seq) AS name FROM {VERSIONS_SQL} GROUP BY k")
def k2_first_wins(spark, d):
    return M.first_wins(versions(spark, d).select("k", "seq", "name"), ["k"], "seq")


PAIR_SQL = "o AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_size END AS size, 'old' AS status FROM part WHERE p_partkey % 4 < 3), n AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(p_name) END AS name, CASE WHEN p_size % 2 = 0 THEN p_size + 100 END AS size, 'new' AS status FROM part WHERE p_partkey % 4 > 0)"


def pair(spark, d):
    part = load(spark, d, "part")
    old = part.where("p_partkey % 4 < 3").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"), F.lit("old").alias("status"))
    new = part.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.upper("p_name")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 100).alias("size"), F.lit("new").alias("status"))
    return old, new


@query(f"WITH {PAIR_SQL} SELECT k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.k IS NOT NULL THEN o.status ELSE n.status END AS status FROM o FULL JOIN n USING (k)")
def k3_subset_upsert(spark, d):
    return M.merge(*pair(spark, d), ["k"], {"name": "new", "status": "old"})


@query(f"WITH {PAIR_SQL} SELECT k, coalesce(nullif(n.name, ''), o.name) AS name, coalesce(n.size, o.size) AS size, coalesce(o.status, n.status) AS status FROM o FULL JOIN n USING (k)")
def k4_coalesce_upsert(spark, d):
    return M.merge(*pair(spark, d), ["k"], {"name": "prefer_new_text", "size": "prefer_new", "status": "prefer_old"})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, 1, l_quantity + 1 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 2 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def k5_replace_children(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = rows.where("l_orderkey % 3 = 0 and l_linenumber = 2").select("l_orderkey", F.lit(1).cast("int").alias("l_linenumber"), (F.col("l_quantity") + 1).alias("l_quantity"))
    return M.replace_children(rows, fresh, ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber <> 3) AND l_linenumber = 3)")
def k6_drop_vanished(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    links = rows.select("l_orderkey", "l_linenumber").distinct()
    seen = links.where("l_orderkey % 5 = 0 and l_linenumber <> 3")
    return M.drop_vanished(links, seen, rows, ["l_orderkey"], ["l_linenumber"])[1]


@query("SELECT c_custkey FROM customer WHERE 'mod:' || c_custkey NOT IN (SELECT 'mod:' || o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def k8_ledger(spark, d):
    key = lambda c: F.concat(F.lit("mod:"), F.col(c).cast("string"))
    ledger = load(spark, d, "orders").where("o_orderstatus = 'F' and o_orderkey % 3 = 0").select(key("o_custkey").alias("key"))
    return M.not_done(load(spark, d, "customer").select("c_custkey", key("c_custkey").alias("key")), ledger, "key").select("c_custkey")


@query("SELECT count(*) AS changed, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'P'")
def k9_bulk_reset(spark, d):
    reset = load(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")))
    return reset.where("status is null and o_orderstatus is not null").agg(F.count(F.lit(1)).alias("changed"), F.min("o_orderkey").alias("first"))


@query(f"WITH {PAIR_SQL} SELECT n.k FROM n LEFT JOIN o USING (k) WHERE o.k IS NULL OR n.name IS DISTINCT FROM upper(o.name)")
def k10_to_embed(spark, d):
    old, new = pair(spark, d)
    return M.to_embed(new.select("k", "name"), old.select("k", F.upper("name").alias("name")), "k", "name").select("k")


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1")
def k11_rebuild(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT p_brand, '[' || string_agg('{\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}', ',' ORDER BY p_partkey) || ']' AS value FROM part GROUP BY 1")
def k13_snapshot(spark, d):
    return M.snapshot(load(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'have' ELSE 'https://parts.example.org/cat/' || replace(p_brand, '#', '%23') || '/dis/sq' || p_partkey || '.gif' END AS url FROM part")
def k14_backfill(spark, d):
    rows = load(spark, d, "part").withColumn("url", F.when(F.col("p_size") % 2 == 0, "have"))
    return M.backfill_url(rows, "url", "https://parts.example.org/cat", F.col("p_brand"), F.col("p_partkey")).select("p_partkey", "url")


@query("SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"chars\":' || length(text) || '}' AS payload FROM conversations")
def k15_log_payloads(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.length("text").alias("chars"))).alias("payload"))
