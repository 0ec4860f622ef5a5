"""Filters, joins, limits and set operations over the catalog view and its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import serials as S
from quarry.functions import text as T
from quarry.operators import joins as J
from quarry.operators.ordering import global_rank
from quarry.operators.shared import dealt
from quarry.registry import query
from quarry.sources.tables import CATALOG_SQL, catalog_view, load


def folded_contains(c: Column, word: str) -> Column:
    """A substring, with A-Z taken as a-z."""
    return F.contains(F.lower(c), F.lit(word.lower()))


def all_words(df: DataFrame, words: list[str], fields: list[str]) -> DataFrame:
    """Every word in some field; no word, no row."""
    if not words:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (folded_contains(F.col(f), w) for f in fields)) for w in words)))


def optional(df: DataFrame, **equal) -> DataFrame:
    """P10: the filters that are given."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def p1_equality(spark, d):
    return load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def p2_substring(spark, d):
    return load(spark, d, "part").where(folded_contains(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring')")
def p3_all_words(spark, d):
    return all_words(load(spark, d, "part"), ["small", "ring"], ["p_name"]).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE FALSE")
def p3_no_words(spark, d):
    return all_words(load(spark, d, "part"), [], ["p_name"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'eco') OR contains(lower(p_type), 'eco')) AND (contains(lower(p_name), 'ed') OR contains(lower(p_type), 'ed'))")
def p4_words_over_fields(spark, d):
    return all_words(load(spark, d, "part"), ["eco", "ed"], ["p_name", "p_type"]).select("p_partkey")


@query("SELECT 'mod:' || p_brand || ':' || p_partkey AS key FROM part WHERE starts_with('mod:' || p_brand || ':' || p_partkey, 'mod:Brand#1:')")
def p5_prefix(spark, d):
    return load(spark, d, "part").select(F.concat(F.lit("mod:"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("key")).where(F.startswith("key", F.lit("mod:Brand#1:")))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY ALL) ON o_custkey = c_custkey WHERE last IS NULL")
def p6_null_state(spark, d):
    last = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return load(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").where("last IS NULL").select("c_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_20')")
def p7_in_list(spark, d):
    return load(spark, d, "nation").where(F.col("n_name").isin("NATION_1", "NATION_7", "NATION_20")).select("n_nationkey", "n_name")


@query("SELECT p_partkey, (CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END + CASE WHEN contains(p_type, 'LARGE') THEN 1 ELSE 0 END) AS score FROM part")
def p8_case_score(spark, d):
    one = lambda c: F.when(c, 1).otherwise(0)
    return load(spark, d, "part").select("p_partkey", (one(F.contains("p_name", F.lit("red"))) + one(F.contains("p_type", F.lit("LARGE")))).alias("score"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'abolito' WHEN 'P' THEN 'non vendibile' END AS status, nullif(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END, 0) AS price FROM orders")
def p9_status(spark, d):
    price = F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice"))
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "abolito").when(F.col("o_orderstatus") == "P", "non vendibile").alias("status"), F.nullif(price, F.lit(0.0)).alias("price"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#7' AND p_size = 3")
def p10_optional_filters(spark, d):
    return optional(load(spark, d, "part"), p_brand="Brand#7", p_type=None, p_size=3).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 7) OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber = 7 AND l_suppkey = 7)")
def p11_unlisted_applies(spark, d):
    listed = load(spark, d, "lineitem").where("l_linenumber = 7").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_suppkey") == 7).alias("mine"))
    return load(spark, d, "part").join(listed, "p_partkey", "left").where("mine IS NULL OR mine").select("p_partkey")


@query("""SELECT p_partkey, c_custkey FROM part, customer WHERE c_custkey % 50 = 0
  AND (c_custkey % 4 = 0 OR ((p_size % 3 = 0 OR 1000 + c_custkey * 10 >= 1000 + p_size) AND (p_size % 3 = 1 OR 1000 + c_custkey * 10 <= 1200 + p_size)))""")
def p12_open_interval(spark, d):
    serial = F.when(F.col("c_custkey") % 4 == 0, F.lit("?")).otherwise(F.concat(F.lit("c"), (F.col("c_custkey") * 10 + 1000).cast("string")))
    low = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("C"), (F.col("p_size") + 1000).cast("string")))
    high = F.when(F.col("p_size") % 3 != 1, F.concat(F.lit("C"), (F.col("p_size") + 1200).cast("string")))
    rows = load(spark, d, "part").select("p_partkey", S.letter_key(low).alias("low"), S.letter_key(high).alias("high"))
    asked = load(spark, d, "customer").where("c_custkey % 50 = 0").select("c_custkey", S.letter_key(serial).alias("key"))  # the stated set of requests
    rows = dealt(rows, "p_partkey")  # few bytes, and each row meets every request: all tasks have some
    return rows.join(asked, S.within(F.col("key"), F.col("low"), F.col("high"))).select("p_partkey", "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 OR p_size = 10 OR p_size = 9")
def p13_applies_to_model(spark, d):
    models = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), F.col("p_size").cast("string")), F.concat(F.lit("m"), (F.col("p_size") + 1).cast("string"))))
    return load(spark, d, "part").withColumn("models", models).where((F.size("models") == 0) | F.exists("models", lambda x: F.upper(x) == "M10")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '\\b(ring|old)\\b')")
def p14_stop_rows(spark, d):
    return load(spark, d, "part").where(~F.col("p_name").rlike(r"\b(ring|old)\b")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '' AND o_orderstatus = 'F'")
def p15_flag(spark, d):
    return load(spark, d, "orders").where("o_orderpriority <> '' AND o_orderstatus = 'F'").select("o_orderkey")


@query("SELECT count(*) AS n, count_if(p_size > 25)::BIGINT AS large, count_if(p_name LIKE 'red%')::BIGINT AS red FROM part")
def p16_conditional_counts(spark, d):
    return load(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.startswith("p_name", F.lit("red"))).alias("red"))


@query(f"WITH {CATALOG_SQL} SELECT code, description, grp, subgroup, drawing, position, quantity, model, brand FROM v")
def j1_catalog_view(spark, d):
    return catalog_view(spark, d).select("code", "description", "grp", "subgroup", "drawing", "position", "quantity", "model", "brand")


@query("SELECT l_partkey, l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN (SELECT s_suppkey, s_nationkey % 7 + 1 AS line, s_name FROM supplier) ON s_suppkey = l_suppkey AND line = l_linenumber WHERE l_partkey = 42")
def j2_occurrences(spark, d):
    supplier = load(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 7 + 1).alias("line"), "s_name")
    line = load(spark, d, "lineitem").where("l_partkey = 42")
    return line.join(supplier, (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("line") == F.col("l_linenumber")), "left").select("l_partkey", "l_orderkey", "l_linenumber", "s_name")


@query(f"WITH {CATALOG_SQL} SELECT DISTINCT code, description, grp FROM v WHERE drawing_name = '2-HIGH'")
def j3_rows_distinct(spark, d):
    return catalog_view(spark, d).where("drawing_name = '2-HIGH'").select("code", "description", "grp").distinct()


@query("SELECT DISTINCT l_partkey, l_suppkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def j4_where_used(spark, d):
    line = load(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    at = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return line.join(at, F.col("s_suppkey") == F.col("l_suppkey")).select("l_partkey", "l_suppkey", "n_name").distinct()


SUBSTITUTION_SQL = "s AS (SELECT p_partkey AS old, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS new FROM part WHERE p_size % 5 = 0)"


def substitutions(spark, d) -> DataFrame:
    """Edges old -> new; made from part keys."""
    part = load(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    return part.where("p_size % 5 = 0").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("old"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("new"))


@query(f"WITH {SUBSTITUTION_SQL} SELECT p_partkey AS code, s.new AS replaced_by, b.old AS replaces FROM part LEFT JOIN s ON s.old = p_partkey LEFT JOIN s b ON b.new = p_partkey")
def j7_substitution_one_hop(spark, d):
    edge = substitutions(spark, d)
    forward, backward = edge.select(F.col("old").alias("code"), F.col("new").alias("replaced_by")), edge.select(F.col("new").alias("code"), F.col("old").alias("replaces"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("code")).join(forward, "code", "left").join(backward, "code", "left")


@query(f"WITH {SUBSTITUTION_SQL} SELECT s.new AS code, s.old, count(*) AS occurrences FROM s JOIN lineitem ON l_partkey = s.old GROUP BY ALL")
def j7_occurrences_of_old(spark, d):
    return substitutions(spark, d).join(load(spark, d, "lineitem"), F.col("l_partkey") == F.col("old")).groupBy(F.col("new").alias("code"), "old").agg(F.count(F.lit(1)).alias("occurrences"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def j8_anti(spark, d):
    return load(spark, d, "part").join(load(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer")
def j9_exists(spark, d):
    has = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return load(spark, d, "customer").join(has, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_pending"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)")
def j9_semi(spark, d):
    return load(spark, d, "supplier").join(load(spark, d, "lineitem").where("l_discount > 0.09D"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size * 3.0::DOUBLE AS y FROM part), h AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS p_brand, s_acctbal % 150 AS y FROM supplier)
  SELECT p_partkey, s_suppkey FROM (SELECT w.p_partkey, h.s_suppkey, row_number() OVER (PARTITION BY w.p_partkey ORDER BY abs(w.y - h.y), h.s_suppkey) AS n FROM w JOIN h USING (p_brand) WHERE abs(w.y - h.y) <= 20) WHERE n = 1""")
def j10_band_nearest(spark, d):
    words = load(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * F.lit(3.0)).alias("y"))
    heads = load(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), (F.col("s_acctbal") % F.lit(150)).alias("hy"))
    return J.band_nearest(words, heads, ["p_brand"], "y", "hy", 20.0, "s_suppkey").select("p_partkey", "s_suppkey")


@query("""WITH st AS (SELECT o_custkey % 150 AS k, epoch(o_orderdate)::BIGINT % 2592000 AS start, o_orderkey AS variant FROM orders),
  g AS (SELECT k, start, min(variant) AS variant, count(DISTINCT variant) AS n FROM st GROUP BY ALL)
  SELECT e.event_id, max(g.start) AS start, max_by(g.variant, g.start) AS variant, max_by(g.n, g.start) AS n_at_start FROM (SELECT event_id, user_id AS k, event_id * 259 AS at FROM events) e LEFT JOIN g ON g.k = e.k AND g.start <= e.at GROUP BY e.event_id""")
def j11_as_of(spark, d):
    starts = load(spark, d, "orders").select((F.col("o_custkey") % 150).alias("k"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 2592000).alias("start"), F.col("o_orderkey").alias("variant"))
    probes = load(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") * 259).alias("at"))
    return J.as_of(probes, starts, ["k"], "at", "start").select("event_id", "start", "variant", "n_at_start")


VARIANTS = "SELECT p_partkey AS variant, p_partkey % 40 AS f, 'NN' || lpad((p_partkey % 40)::VARCHAR, 4, '0') AS p, 10000 + p_size * 100 AS start FROM part"
REQUESTS = "SELECT c_custkey AS request, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN 'QQQ' ELSE 'NX' || lpad((c_custkey % 40)::VARCHAR, 4, '0') END AS q, 9000 + (c_custkey * 13) % 7000 AS n FROM customer"


@query(f"""WITH v AS ({VARIANTS}), r AS ({REQUESTS}),
  c AS (SELECT r.request, r.n, v.variant, v.start FROM r JOIN v ON r.q = '' OR (length(r.q) = length(v.p) AND hamming(r.q, v.p) <= 3)),
  b AS (SELECT request, max(start) FILTER (start <= n) AS best FROM c GROUP BY 1),
  x AS (SELECT c.request, count(DISTINCT variant) AS k, min(variant) AS variant FROM c JOIN b USING (request) WHERE start = best GROUP BY 1)
  SELECT r.request, CASE WHEN b.request IS NULL THEN 'none_compatible' WHEN best IS NULL THEN 'too_early' WHEN k > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN k = 1 THEN variant END AS variant, best::BIGINT AS start, coalesce(k, 0) AS n_variants
  FROM r LEFT JOIN b USING (request) LEFT JOIN x USING (request)""".replace("hamming(r.q, v.p)", "hamming(CASE WHEN length(r.q) = length(v.p) THEN r.q ELSE v.p END, v.p)"))
def j11_resolve_serials(spark, d):
    variants = load(spark, d, "part").select(F.col("p_partkey").alias("variant"), F.concat(F.lit("NN"), F.lpad((F.col("p_partkey") % 40).cast("string"), 4, "0"), (F.col("p_size") * 100 + 10000).cast("string")).alias("starts"))
    k = F.col("c_custkey")
    prefix = F.when(k % 10 == 0, "").when(k % 10 == 1, "QQQ").otherwise(F.concat(F.lit("NX"), F.lpad((k % 40).cast("string"), 4, "0")))
    requests = load(spark, d, "customer").select(k.alias("request"), F.concat(prefix, F.lpad(((k * 13) % 7000 + 9000).cast("string"), 5, "0")).alias("serial"))
    return J.resolve_serials(requests, variants)


@query("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE hamming(left(md5(c_name), 6), left(md5(s_name), 6)) <= 3")
def j12_hamming(spark, d):
    a = load(spark, d, "customer").select("c_custkey", F.left(F.md5("c_name"), F.lit(6)).alias("a"))
    b = load(spark, d, "supplier").select("s_suppkey", F.left(F.md5("s_name"), F.lit(6)).alias("b"))
    return J.near_pairs(a, "a", b, "b").join(a, "a").join(b, "b").select("c_custkey", "s_suppkey")


@query("""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS a FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM conversations)
  SELECT a, b FROM a JOIN b ON left(a, 3) = left(b, 3) AND (a = b OR (least(length(a), length(b)) >= 4 AND abs(length(a) - length(b)) <= 2 AND (starts_with(a, b) OR starts_with(b, a)))) UNION SELECT a, b FROM a JOIN b ON a = b""")
def j13_prefix_tokens(spark, d):
    def tokens(name: str, to: str) -> DataFrame:
        return load(spark, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias(to)).distinct()

    return J.match_tokens(tokens("benchmark", "a"), tokens("conversations", "b"))


#: A small rule vocabulary for the words that part names are made of: priority, pattern, concept.
RULES = [(1, r"\bring\b.*\bwasher\b", "washer"), (2, r"\b(small|cold) ring\b", "seal"), (3, r"\bring\b", "ring"), (4, r"\b(bolt|rod)\b", "fastener"), (5, r"\bold\b", "spare"), (6, r"gear|gizmo", "drive"), (7, r"\b(red|blue) ", "painted")]
CONTEXTS = [(1, "econ", "basic cheap"), (2, "^(SMALL|MEDIUM)$", "compact"), (3, "o", "round"), (4, "large", "heavy frame")]
RULES_SQL = "(VALUES " + ", ".join(f"({p}, '{r}', '{c}')" for p, r, c in RULES) + ") AS r(priority, pattern, concept)"
CONTEXTS_SQL = "(VALUES " + ", ".join(f"({p}, '{r}', '{c}')" for p, r, c in CONTEXTS) + ") AS r(priority, pattern, words)"


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "priority int, pattern string, concept string")


def contexts(spark) -> DataFrame:
    return spark.createDataFrame(CONTEXTS, "priority int, pattern string, words string")


@query(f"SELECT p_partkey, (SELECT min_by(concept, priority) FROM {RULES_SQL} WHERE regexp_matches(p_name, pattern)) AS concept FROM part")
def j14_first_rule(spark, d):
    part = load(spark, d, "part")
    return part.join(J.first_rule(part, "p_name", rules(spark)), "p_name").select("p_partkey", "concept")


@query(f"SELECT p_partkey, coalesce((SELECT string_agg(words, ' ' ORDER BY priority) FROM {CONTEXTS_SQL} WHERE regexp_matches(p_type, '(?i)' || pattern)), '') AS words FROM part")
def j15_all_contexts(spark, d):
    part = load(spark, d, "part")
    return part.join(J.all_contexts(part, "p_type", contexts(spark)), "p_type").select("p_partkey", "words")


@query("SELECT l_orderkey, l_linenumber, l_partkey, any_parent FROM lineitem JOIN (SELECT o_orderkey, min(o_custkey) AS any_parent FROM orders GROUP BY 1) ON o_orderkey = l_orderkey")
def j16_any_parent(spark, d):
    parent = load(spark, d, "orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.min("o_custkey").alias("any_parent"))
    return load(spark, d, "lineitem").join(parent, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "any_parent")


@query("SELECT o_custkey, count(*) AS lines, min(l_shipmode) AS first_line FROM (SELECT l_orderkey AS k, l_linenumber AS l_shipmode FROM lineitem) JOIN (SELECT o_orderkey AS k, o_custkey FROM orders) USING (k) GROUP BY o_custkey")
def j17_using(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), "k").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("lines"), F.min("l_linenumber").alias("first_line"))


@query("""WITH f AS (SELECT DISTINCT lpad((p_partkey * 11)::VARCHAR, 6, '0') AS code FROM part), k AS (SELECT DISTINCT lpad(p_partkey::VARCHAR, 6, '0') AS near FROM part),
  x AS (SELECT code, near, list_filter(range(1, 7), lambda i: code[i] <> near[i]) AS d FROM f, k)
  SELECT code, near, place FROM (SELECT code, near, d[1] AS place, row_number() OVER (PARTITION BY code ORDER BY d[1], near) AS n FROM x WHERE len(d) = 1) WHERE n = 1""")
def j18_one_digit(spark, d):
    six = lambda c: F.lpad(c.cast("string"), 6, "0")
    part = load(spark, d, "part")
    return J.one_digit_neighbours(part.select(six(F.col("p_partkey") * 11).alias("code")), part.select(six(F.col("p_partkey")).alias("code"))).select("code", "near", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, concat_ws('; ', 'MOD. ' || (p_size % 7), CASE WHEN p_size % 2 = 0 THEN 'MOD. 9' END) AS notes FROM part")
def j19_note_legend(spark, d):
    legend = F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(10)]), F.array(*[F.lit(f"MOD. {i}") for i in range(10)]))
    marks = F.array((F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 2 == 0, "9").otherwise("none"))
    return load(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.transform(marks, lambda m: legend[m]), lambda x: x.isNotNull()), "; ").alias("notes"))


@query(f"SELECT concept, count(*) AS n FROM (SELECT (SELECT min_by(concept, priority) FROM {RULES_SQL} WHERE regexp_matches(p_name, pattern)) AS concept FROM part) WHERE concept IS NOT NULL GROUP BY 1")
def j20_found_as(spark, d):
    part = load(spark, d, "part")
    return part.join(J.first_rule(part, "p_name", rules(spark)), "p_name").where("concept IS NOT NULL").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT code, CASE WHEN count(DISTINCT marca) = 1 THEN 'one' ELSE 'many' END AS outcome, min(marca) AS marca FROM (SELECT p_partkey AS code, 'parts' AS marca FROM part UNION ALL SELECT s_suppkey, 'suppliers' FROM supplier) GROUP BY code")
def j21_federated(spark, d):
    sources = {"parts": load(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description")), "suppliers": load(spark, d, "supplier").select(F.col("s_suppkey").alias("code"))}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("marca", F.lit(k)) for k, df in sources.items()))
    return rows.groupBy("code").agg(F.when(F.countDistinct("marca") == 1, "one").otherwise("many").alias("outcome"), F.min("marca").alias("marca"))


@query("SELECT n_name, r_name AS canonical FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, r_name FROM region")
def j22_aliases(spark, d):
    region = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    named = load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("aliases")).join(region, "n_regionkey")
    return named.select(F.explode(F.concat("aliases", F.array("r_name"))).alias("n_name"), F.col("r_name").alias("canonical"))


@query(f"WITH {CATALOG_SQL} SELECT code, drawing, position, price FROM v WHERE grp = 'PROMO' ORDER BY price DESC, drawing, position, code LIMIT 60")
def o1_order_limit(spark, d):
    return catalog_view(spark, d).where("grp = 'PROMO'").select("code", "drawing", "position", "price").orderBy(F.desc("price"), "drawing", "position", "code").limit(60)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus <> 'P')::INT, o_orderkey) AS place FROM orders")
def o5_started_first(spark, d):
    rows = load(spark, d, "orders")
    return global_rank(rows, (F.col("o_orderstatus") != "P").cast("int"), F.col("o_orderkey")).select("o_orderkey", "place")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def o8_order_by_alias(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderstatus")


@query("SELECT c_custkey, row_number() OVER (ORDER BY last ASC NULLS FIRST, c_custkey) AS place FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def o9_nulls_first(spark, d):
    last = load(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last"))
    rows = load(spark, d, "customer").join(last, "c_custkey", "left")
    return global_rank(rows, F.asc_nulls_first("last"), F.col("c_custkey")).select("c_custkey", "place")


@query("""WITH a AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS code FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS code FROM lineitem WHERE l_returnflag = 'R')
  SELECT code, 'only_left' AS side FROM a WHERE code NOT IN (SELECT code FROM r) UNION ALL SELECT code, 'only_right' FROM r WHERE code NOT IN (SELECT code FROM a)""")
def u1_difference(spark, d):
    code = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("code")
    return J.one_sided(*(load(spark, d, "lineitem").where(f"l_returnflag = '{f}'").select(code) for f in "AR"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_orderkey, list_has_any(['red', 'old'], list(split_part(p_name, ' ', 1))) AS meets FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def u3_overlap(spark, d):
    words = catalog_view(spark, d).groupBy(F.col("drawing").alias("o_orderkey")).agg(F.collect_set(F.split_part("description", F.lit(" "), F.lit(1))).alias("w"))
    return words.select("o_orderkey", F.arrays_overlap("w", F.array(F.lit("red"), F.lit("old"))).alias("meets"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def u4_distinct(spark, d):
    return load(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT l_partkey, min(l_suppkey) AS only_supplier FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def u5_exclusive(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"), F.min("l_suppkey").alias("only_supplier")).where("n = 1").drop("n")
