"""Extraction from pages, grids, word boxes and running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import machines as M
from quarry.operators.shared import dealt
from quarry.registry import query
from quarry.sources import documents as D
from quarry.sources import grids as G
from quarry.sources import html as H
from quarry.sources.tables import load

LINK_SQL = """WITH f AS (SELECT page_id, url AS base, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_extract_all(html, '(?i)<(?:a|area|frame|iframe)\\b[^>]*?\\b(?:href|src)\\s*=\\s*["'']([^"''#]+)', 1) AS hs FROM pages),
  e AS (SELECT page_id, base, root, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM f),
  a AS (SELECT page_id, i, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h WHEN starts_with(h, '/') THEN root || h ELSE root || '/' || h END AS url FROM e)
  SELECT page_id, url, (row_number() OVER (PARTITION BY page_id ORDER BY min(i)))::INT AS place FROM a WHERE NOT regexp_matches(lower(url), '\\.(pdf|jpg|jpeg|gif|png|zip|exe|doc|xls)(\\?|$)') GROUP BY page_id, url"""


@query(LINK_SQL)
def s7_links(spark, d):
    return H.links(load(spark, d, "pages")).select("page_id", "url", "place")


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<table\\b') THEN 'table' WHEN regexp_matches(html, '(?i)<(ul|ol)\\b') THEN 'list' ELSE 'text' END AS kind, md5(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def s10_page_kind(spark, d):
    return load(spark, d, "pages").select("page_id", H.page_kind(F.col("html")).alias("kind"), F.md5(H.title(F.col("html"))).alias("title"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def s4_json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS label, p_size % 3 <> 0 AS sellable FROM part")
def s5_json_normaliser(spark, d):
    flag = F.when(F.col("p_size") % 3 == 0, "N").when(F.col("p_size") % 3 == 1, "Y").otherwise("TRUE")
    obj = F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("name"), F.col("p_type").alias("title"), flag.alias("sell")))
    return load(spark, d, "part").select("p_partkey", H.pick(obj, "name", "title").alias("label"), H.truth(F.get_json_object(obj, "$.sell")).alias("sellable"))


@query("SELECT p_brand, count(*) AS items, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1")
def s4_json_list(spark, d):
    made = load(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.col("p_name").alias("des"))))).alias("j"))
    items = made.select("p_brand", F.inline(H.json_items(F.col("j"))))
    return items.groupBy("p_brand").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.col("id").cast("long"))), lambda x: x.cast("string")), ",").alias("ids"))


def table_pages(spark, d):
    """Pages whose body is a table of an order's lines: made from the tables, as the portals write them."""
    cell = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("<td><a href='/part/"), F.col("l_partkey").cast("string"), F.lit("'>P"), F.col("l_partkey").cast("string"), F.lit("</a></td><td> "), "p_name", F.lit("<br>"), F.col("p_type"), F.lit(" </td></tr>"))
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.concat(F.lit("<html><table><tr><th>Pos</th></tr>"), F.array_join(F.array_sort(F.collect_list(cell)), ""), F.lit("</table></html>")).alias("html"))


@query("SELECT l_orderkey AS page_id, l_linenumber::VARCHAR AS position, 'P' || l_partkey AS code, p_name || ' ' || p_type AS description, '/part/' || l_partkey AS href FROM lineitem JOIN part ON p_partkey = l_partkey")
def s6_table_rows(spark, d):
    return H.wide_rows(H.table_cells(table_pages(spark, d)), ["position", "code", "description"], 3).select("page_id", "position", "code", "description", "href")


@query("SELECT DISTINCT l_orderkey AS page_id, 'P' || l_partkey AS code FROM lineitem")
def s6_keep_first(spark, d):
    return H.keep_first(H.wide_rows(H.table_cells(table_pages(spark, d)), ["position", "code", "description"], 3), "code").select("page_id", "code")


@query("SELECT p_partkey, (p_size + 7)::BIGINT AS total FROM part")
def s13_page_total(spark, d):
    return load(spark, d, "part").select("p_partkey", H.page_total(F.concat(F.lit("1 of 3 ... Pagina 2 di "), (F.col("p_size") + 7).cast("string"))).alias("total"))


@query("SELECT l_orderkey AS grid, l_linenumber AS row, c AS col, 'q' || (c - c % (1 + l_linenumber % 3)) AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), range(0, 6) AS t(c)")
def s14_fill_merged(spark, d):
    keys = dealt(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("grid"), F.col("l_linenumber").alias("row")), "grid", "row").distinct()
    cells = keys.select("grid", "row", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("col"))
    return D.fill_merged(cells.withColumn("text", F.when(F.col("col") % (1 + F.col("row") % 3) == 0, F.concat(F.lit("q"), F.col("col").cast("string"))))).select("grid", "row", "col", "text")


@query("""WITH r AS (SELECT user_id AS grid, event_id AS row, CASE WHEN event_type IN ('view', 'click') THEN 'c' || event_id END AS code, event_type AS description FROM events), i AS (SELECT *, count(code) OVER (PARTITION BY grid ORDER BY row ROWS UNBOUNDED PRECEDING) AS k FROM r)
  SELECT grid, min(row) AS row, min_by(code, row) AS code, string_agg(description, ' ' ORDER BY row) AS description FROM i WHERE k > 0 GROUP BY grid, k""")
def s14_continuations(spark, d):
    e = load(spark, d, "events")
    rows = e.select(F.col("user_id").alias("grid"), F.col("event_id").alias("row"), F.lit(None).cast("string").alias("position"), F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("code"), F.col("event_type").alias("description"))
    return D.join_continuations(rows).select("grid", "row", "code", "description")


BOX_SQL = "w AS (SELECT p_partkey % 50 AS page, p_name AS word, (p_partkey * 7919 % 997)::DOUBLE AS wx, (p_partkey * 104729 % 499)::DOUBLE AS wy, p_size / 50.0 AS confidence FROM part), a AS (SELECT s_suppkey % 50 AS page, s_suppkey AS position, (s_suppkey * 31 % 499)::DOUBLE AS y FROM supplier)"


@query(f"WITH {BOX_SQL} SELECT w.page, a.position, string_agg(word, ' ' ORDER BY wx, word) AS description, round(avg(confidence), 6) AS confidence, min(wx) AS x0, max(wx + 5) AS x1 FROM a JOIN w ON w.page = a.page AND abs(wy - y) <= 20 GROUP BY 1, 2")
def s16_ocr_rows(spark, d):
    k = F.col("p_partkey")
    wx, wy = (k * 7919 % 997).cast("double"), (k * 104729 % 499).cast("double")
    words = load(spark, d, "part").select((k % 50).alias("page"), F.col("p_name").alias("word"), wx.alias("wx"), wy.alias("wy"), (wx + 5).alias("x1"), (wy + 5).alias("y1"), (F.col("p_size") / F.lit(50.0)).alias("confidence"))
    anchors = load(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("page"), F.col("s_suppkey").alias("position"), (F.col("s_suppkey") * 31 % 499).cast("double").alias("y"))
    return D.ocr_rows(anchors, words).select("page", "position", "description", F.round("confidence", 6).alias("confidence"), "x0", "x1")


BOXES = """w AS (
    SELECT k // 40 AS page, x AS x0, y AS y0, x + 4 AS x1, y + 8 AS y1, word FROM (
      SELECT p_partkey AS k, (p_partkey * 7919 % 997)::DOUBLE AS x, (p_partkey * 104729 % 61)::DOUBLE AS y, CASE WHEN p_partkey % 4 = 0 THEN (1000000 + p_partkey)::VARCHAR ELSE p_name END AS word FROM part
      UNION ALL SELECT p_partkey, (p_partkey * 31 % 800)::DOUBLE, 10.0 * (p_partkey % 7), 'Item' FROM part WHERE p_partkey % 10 = 3
      UNION ALL SELECT p_partkey, (p_partkey * 31 % 800)::DOUBLE + 0.001, 10.0 * (p_partkey % 7), 'No.' FROM part WHERE p_partkey % 10 = 3
      UNION ALL SELECT p_partkey, (p_partkey * 31 % 800)::DOUBLE + 0.002, 10.0 * (p_partkey % 7), p_size::VARCHAR FROM part WHERE p_partkey % 10 = 3)),
  c AS (SELECT page, x0, y0, word AS code FROM w WHERE regexp_matches(word, '^[0-9]{7}$')),
  n AS (SELECT c.*, w.x0 AS wx, round(w.y0) AS wy, w.word, regexp_matches(w.word, '^[0-9]{7}$') AS is_code FROM c JOIN w ON w.page = c.page AND abs(w.y0 - c.y0) < 2.5 AND w.x1 <= c.x0 + 1),
  l AS (SELECT page, x0, y0, code, max((wx, wy, word)) FILTER (is_code) AS last FROM n GROUP BY ALL),
  s AS (SELECT n.page, n.x0, n.y0, n.code, string_agg(n.word, ' ' ORDER BY n.wx, n.wy, n.word) AS description FROM n JOIN l USING (page, x0, y0, code) WHERE NOT n.is_code AND (l.last IS NULL OR (n.wx, n.wy, n.word) > l.last) GROUP BY ALL),
  r AS (SELECT page, lag(x0) OVER o AS hx, lag(y0) OVER o AS hy, lower(lag(word) OVER o) AS first, lower(word) AS second, lead(word) OVER o AS position FROM w WINDOW o AS (PARTITION BY page ORDER BY round(y0), x0, word)),
  h AS (SELECT * FROM r WHERE first = 'item' AND second IN ('no', 'no.') AND regexp_matches(position, '^[0-9]+$'))"""


@query(f"""WITH {BOXES} SELECT s.page, s.x0, s.y0, s.code, arg_max(h.position, (hx, hy, h.position)) AS position, any_value(s.description) AS description
  FROM s LEFT JOIN h ON h.page = s.page AND hy < s.y0 AND hx <= s.x0 + 5 GROUP BY ALL""")
def s15_codes_on_drawings(spark, d):
    part, k = load(spark, d, "part"), F.col("p_partkey")
    box = lambda x, y, word, of=part: of.select(F.floor(k / 40).alias("page"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 8).alias("y1"), word.alias("word"))
    words = box((k * 7919 % 997).cast("double"), (k * 104729 % 61).cast("double"), F.when(k % 4 == 0, (1000000 + k).cast("string")).otherwise(F.col("p_name")))
    for i, word in enumerate((F.lit("Item"), F.lit("No."), F.col("p_size").cast("string"))):
        words = words.union(box((k * 31 % 800).cast("double") + i / 1000, 10.0 * (k % 7), word, part.where(k % 10 == 3)))
    return D.codes_on_drawing(words)


@query()
def s17_sections(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("manual"), F.lit(1).cast("long").alias("page"), "text")
    return D.sections(D.manual_lines(texts)).select("manual", "section", "part", "title", "first_page", F.md5("body").alias("body"))


# A grid an order: a title, models over the quantities, one line a row, its quantity merged over the next column, and a second text for every third
GRID_LINES = "FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_partkey, l_quantity::INT AS q FROM lineitem) JOIN part ON p_partkey = l_partkey"


def order_grids(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = dealt(load(spark, d, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("grid"), place.alias("n"), "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("q"))
    lines = lines.join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    n, code, none = F.col("n"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"), F.lit(None).cast("string")
    cells = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    own = cells(n.cast("string"), code, F.col("p_name"), F.col("q"), none, (n % 5).cast("string"), n.cast("string"), code, F.col("p_type"), F.col("q"), F.concat(F.lit("MB "), 100 + n, F.lit(", "), 200 + n))
    more = F.when(n % 3 == 0, cells("", "", "more", "", "", "", "", "", "long", "", "")).otherwise(cells(*["x"] * 4, *[""] * 7))
    rows = lines.select("grid", F.explode(F.array(F.struct((n * 2 + 10).cast("long").alias("row"), own.alias("cells")), F.struct((n * 2 + 11).cast("long").alias("row"), F.when(n % 3 == 0, more).alias("cells")))).alias("r")).select("grid", "r.row", "r.cells").where("cells is not null")
    heads = [["Table of parts", *[""] * 10], ["", "", "", "KH 130", "HD", "KM 50", *[""] * 5], ["", "", "", "", "125", *[""] * 6], ["Item No", "Part No", "Description", "QTY", "", "", "ITEM NO.", "Sales code", "Item name", "Qty", "Model"]]
    top = lines.select("grid").distinct().select("grid", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("row"), cells(*h).alias("cells")) for i, h in enumerate(heads)])).alias("r")).select("grid", "r.row", "r.cells")
    return rows.union(top).select("grid", "row", F.posexplode("cells").alias("col", "text"))


@query(f"""SELECT l_orderkey AS grid, 2 AS tab, n::VARCHAR AS position, lpad(l_partkey::VARCHAR, 7, '0') AS code, p_name || CASE WHEN n % 3 = 0 THEN ' more' ELSE '' END AS description,
    CASE WHEN q = n % 5 THEN q::VARCHAR END AS quantity, 'HD 125=' || q || ',KH 130=' || q || ',KM 50=' || (n % 5) AS models {GRID_LINES}
  UNION ALL SELECT l_orderkey, 4, n::VARCHAR, lpad(l_partkey::VARCHAR, 7, '0'), p_type || CASE WHEN n % 3 = 0 THEN ' long' ELSE '' END, q::VARCHAR, 'MB ' || (100 + n) || '=' || q || ',MB ' || (200 + n) || '=' || q {GRID_LINES}""")
def s14_grid_parts(spark, d):
    parts = G.grid_parts(order_grids(spark, d))
    said = F.array_sort(F.transform(F.map_entries("models"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return parts.select("grid", F.col("tab").cast("int").alias("tab"), "position", "code", "description", "quantity", F.array_join(said, ",").alias("models"))


@query("SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def f29_url_parts(spark, d):
    return load(spark, d, "pages").select("url", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"), F.nullif(F.regexp_extract("url", r"[?&]page=([^&#]*)", 1), F.lit("")).alias("page"))


@query("SELECT page_id, length(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) > 0 AS has_heading FROM pages")
def f41_page_predicates(spark, d):
    return load(spark, d, "pages").select("page_id", (F.length(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)) > 0).alias("has_heading"))


@query("SELECT p_brand || '.pdf' AS file, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE '%2%' THEN 'two' END AS series FROM (SELECT DISTINCT p_brand FROM part)")
def f37_series_of_file(spark, d):
    from quarry.operators import joins as J

    files = load(spark, d, "part").select(F.concat("p_brand", F.lit(".pdf")).alias("file")).distinct()
    order = spark.createDataFrame([(1, "^Brand#1", "one"), (2, "2", "two")], "priority int, pattern string, concept string")
    return J.first_rule(files, "file", order).select("file", F.col("concept").alias("series"))


NORMAL_SQL = "trim(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g'))"
ALIASES = [["alpha", "the"], ["beta", "in the"]]


@query(f"""WITH m AS (SELECT conv_id, turn, {NORMAL_SQL.format("text")} AS t, {NORMAL_SQL.format("CASE turn % 3 WHEN 0 THEN left(text, 12) WHEN 1 THEN 'no such words' END")} AS q, turn % 2 = 0 AS even FROM conversations)
  SELECT conv_id, turn, (q <> '' AND contains(t, q)) OR CASE WHEN even THEN regexp_matches(t, '\\b(alpha|the)\\b') ELSE regexp_matches(t, '\\bbeta\\b|in the') END AS declared FROM m""")
def f35_declared_brand(spark, d):
    t = F.col("turn")
    quote = F.when(t % 3 == 0, F.left("text", F.lit(12))).when(t % 3 == 1, "no such words")
    brand = F.when(t % 2 == 0, "Alpha").otherwise("IN-the")
    return load(spark, d, "conversations").select("conv_id", "turn", M.declared_brand(quote, brand, F.col("text"), ALIASES).alias("declared"))


WORDS_SQL = "list_distinct(list_filter(string_split({}, ' '), lambda x: length(x) >= 2 AND x <> 'brand'))"
NUMBERS_SQL = "list_filter({}, lambda x: regexp_full_match(x, '[0-9]+'))"


@query(f"""WITH p AS (SELECT p_partkey, {NORMAL_SQL.format("p_brand || ' ' || p_name || '-' || p_size")} AS a, {NORMAL_SQL.format("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' || (p_size + 1) WHEN 2 THEN 'Krypton 115' END")} AS b,
    CASE p_partkey % 5 WHEN 0 THEN p_partkey + 1 WHEN 1 THEN p_partkey END AS serial FROM part),
  w AS (SELECT *, {WORDS_SQL.format("a")} AS wa, {WORDS_SQL.format("b")} AS wb FROM p), n AS (SELECT *, {NUMBERS_SQL.format("wa")} AS na, {NUMBERS_SQL.format("wb")} AS nb FROM w)
  SELECT p_partkey, a AS norm, coalesce(serial <> p_partkey, false) OR (len(wa) > 0 AND len(wb) > 0 AND NOT list_has_any(wa, wb)) OR (len(na) > 0 AND len(nb) > 0 AND NOT list_has_any(na, nb)) AS changed FROM n""")
def f34_normalised_model(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    active = F.concat("p_brand", F.lit(" "), name, F.lit("-"), F.col("p_size").cast("string"))
    asked = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(name, F.lit(" "), (F.col("p_size") + 1).cast("string"))).when(k % 4 == 2, "Krypton 115")
    serial = F.when(k % 5 == 0, F.concat(F.lit("ab-"), (k + 1).cast("string"))).when(k % 5 == 1, F.concat(F.lit("ab "), k.cast("string")))
    changed = M.machine_changed(serial, asked, F.concat(F.lit("AB"), k.cast("string")), active, ["brand"])
    return load(spark, d, "part").select("p_partkey", M.normal(active).alias("norm"), changed.alias("changed"))
