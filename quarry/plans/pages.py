"""S9 and S11 over the node table: each query writes its pages from the tables, as the portals do, and its SQL reads the rows they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import arrow_interval
from quarry.plans.portals import LINES, SERIAL, lines_of_orders
from quarry.registry import query
from quarry.sources import catalog_pages as C
from quarry.sources import drawings as D
from quarry.sources import nodes as N
from quarry.sources.tables import load

SITE = "http://site"


def keys():
    """The number of a line on its page, its part, and the page."""
    return F.col("l_linenumber"), F.col("l_partkey"), F.col("page_id")


def said(*pieces):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pieces])


# ---- S9: the number of a drawing comes from its heading, an anchor, a remark or the file, as the order's key has it modulo 4
NEW_ID = "(10 + l_orderkey % 4) || '_' || (l_orderkey % 1000) || '_A'"


def new_pages(spark, d):
    n, k, o = keys()
    serial = said("A", 100000 + k % 900000)
    part = said("<tr><td>", n, "<td><a href='x.asp?l=1&amp;CODICE=P", k, "&z'>P</a><td>", F.col("p_name"), " (", n, ")<td>", n % 7, "</tr>")
    note = said("<tr><td><td colspan=3>(", n, ") ", F.when(n % 3 == 0, said("</tr><tr><td>", F.col("p_type"))).otherwise(F.col("p_type")), "</td></tr>")
    until, since = said("<tr><td>VALIDO FINO ALLA MACCHINA ", serial, "</tr>"), said("<tr><td>valida dalla<td>macchina</tr><tr><td>see <b>", serial, "</b></tr>")
    pages = lines_of_orders(spark, d, part, note, F.when(n % 4 == 1, until).when(n % 4 == 2, since).otherwise(""))
    kind, name = o % 4, said(10 + o % 4, "_", o % 1000, "_A")
    said_id = F.when(kind == 0, said("<h2 class=C>", name, "</h2>")).otherwise("")
    anchor = F.when(kind == 1, said("<a name='", name, "'></a>")).when(kind == 2, said("<!-- TAVOLA ", name, " -->")).otherwise("")
    url = said("http://h/p/q/", F.when(kind == 3, said("t", ".", name, ".html")).otherwise("x.html"))
    head = said("<html><body>", anchor, "<table><tr><td><h3>Machine ", o, "</h3>", said_id, "GR TAV<p>mod ", o, "/2</p><p>TITLE ", o, "</p>01.2020<img src=x.gif><img class=tav src='../i", o, ".gif'><table><tr><th>Pos.<th>Descrizione</tr>")
    return pages.select("page_id", url.alias("url"), F.concat(head, F.col("html"), F.lit("</table></table></body>")).alias("html"))


@query(f"SELECT l_orderkey AS page_id, {NEW_ID} AS drawing, l_linenumber::VARCHAR AS position, 'P' || l_partkey AS code, p_name AS description, (l_linenumber % 7)::VARCHAR AS quantity, l_linenumber::VARCHAR AS notes {LINES}")
def s9_new_parts(spark, d):
    return D.NewDrawings(new_pages(spark, d)).parts().select("page_id", "drawing", "position", "code", "description", "quantity", F.array_join("notes", ",").alias("notes"))


@query(f"SELECT l_orderkey AS page_id, {NEW_ID} AS drawing, l_linenumber::VARCHAR AS note, p_type AS text {LINES}")
def s9_new_notes(spark, d):
    return D.NewDrawings(new_pages(spark, d)).notes().select("page_id", "drawing", "note", "text")


@query(f"""SELECT l_orderkey AS page_id, {NEW_ID} AS drawing, coalesce(arg_max({SERIAL}, l_linenumber) FILTER (l_linenumber % 4 = 2), '') AS valid_from, coalesce(arg_max({SERIAL}, l_linenumber) FILTER (l_linenumber % 4 = 1), '') AS valid_to,
  string_agg(CASE WHEN l_linenumber % 4 = 1 THEN 'VALIDO FINO ALLA MACCHINA ' || {SERIAL} ELSE 'valida dalla macchina see ' || {SERIAL} END, ' ' ORDER BY l_linenumber) AS validity_text {LINES} WHERE l_linenumber % 4 IN (1, 2) GROUP BY 1, 2""")
def s9_new_validity(spark, d):
    return D.NewDrawings(new_pages(spark, d)).validity().drop("block")


@query(f"""SELECT DISTINCT l_orderkey AS page_id, {NEW_ID} AS drawing, (10 + l_orderkey % 4)::VARCHAR AS grp, (l_orderkey % 1000) || '_A' AS number, 'Machine ' || l_orderkey AS machine, 'mod ' || l_orderkey || '/2' AS models,
  'TITLE ' || l_orderkey AS title, '01.2020' AS date, 'http://h/p/i' || l_orderkey || '.gif' AS image {LINES}""")
def s9_new_headers(spark, d):
    return D.NewDrawings(new_pages(spark, d)).headers().drop("block")


@query(f"""SELECT l_orderkey AS page_id, CASE WHEN l_partkey % 2 = 0 THEN '20_' || (l_partkey % 1000) ELSE 'L' || min(l_linenumber) END AS drawing, 'L' || min(l_linenumber) AS label, arg_min(p_name, l_linenumber) AS title,
  'http://h/g/' || CASE WHEN l_partkey % 2 = 0 THEN 'd20_' || (l_partkey % 1000) || '_' || l_partkey || '/20_' || (l_partkey % 1000) ELSE 'n' || l_partkey END || '.html' AS url {LINES} GROUP BY l_orderkey, l_partkey""")
def s9_group_index(spark, d):
    n, k, _ = keys()
    file = F.when(k % 2 == 0, said("d20_", k % 1000, "_", k, "/20_", k % 1000)).otherwise(said("n", k))
    pages = lines_of_orders(spark, d, "<tr><td><a class='x grup' href='", file, ".html#a", n, "'>L", n, "</a><td>y<td>", F.col("p_name"), "</tr>", head="<table>", tail="</table><a href='z.html'>z</a>")
    pages = pages.withColumn("url", F.lit("http://h/g/grup20.html"))
    return D.group_drawings(N.page_arrays(pages, "url", paths=True), pages).drop("place")


# ---- S11
def nodes_of(pages, paths=False):
    return N.page_arrays(pages, paths=paths)


FIRST_LINES = f"FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS nth {LINES}) WHERE nth = 1"


@query(f"SELECT l_orderkey AS page_id, p_name AS name, '/c/' || l_partkey AS url, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber::BIGINT END AS n_products {FIRST_LINES}")
def s11_subcategories(spark, d):
    n, k, _ = keys()
    button = F.when(n % 2 == 0, said("<a class='btn' href='#'>all (", n, ")</a>")).otherwise("")
    pages = lines_of_orders(spark, d, "<div class='panel-schema'><div class='panel-heading'><a href='/up'>up</a> → <a href='http://h/c/", k, "?x=1'>", F.col("p_name"), "</a></div>", button, "</div>", head="<section class='category_list'>", tail="</section>")
    return C.subcategories(nodes_of(pages)).drop("place")


PRODUCT_SQL = f"""SELECT l_orderkey AS page_id, p_name AS name, CASE l_linenumber % 3 WHEN 0 THEN 'kits-' WHEN 1 THEN 'attrezzi-' ELSE 'm-' END || l_partkey AS slug, '/m/' || l_partkey AS url, CASE WHEN l_linenumber % 2 = 0 THEN '15-' || l_suppkey END AS high,
  CASE WHEN l_linenumber % 2 = 0 THEN 'http://site/files/' || l_partkey || '.png' ELSE '' END AS image, CASE l_linenumber % 3 WHEN 0 THEN 'kit' WHEN 1 THEN 'tools' ELSE 'model' END AS kind {LINES}"""


@query(PRODUCT_SQL)
def s11_products(spark, d):
    n, k, _ = keys()
    slug = said(F.when(n % 3 == 0, "kits-").when(n % 3 == 1, "attrezzi-").otherwise("m-"), k)
    serial = F.when(n % 2 == 0, said(" (-> 15-", F.col("l_suppkey"), ")")).otherwise("")
    image = F.when(n % 2 == 0, said("<img data-loadimage='/imageserver/x/files/", k, ".png'>")).otherwise("<img src='/none.png'>")
    item = said("<article class='prodotto_item'><a href='/other'>o</a>", image, "<p class='nome-categoria'>", F.col("p_name"), serial, "<br>", slug, "</p><div class='product-actions'><a href='http://h/m/", k, "?v'>go</a></div></article>")
    pages = lines_of_orders(spark, d, item, head="<article class='prodotto_item'><a href='/x'>outside</a></article><section class='result_list'>", tail="</section>")
    return C.products(nodes_of(pages), SITE).select("page_id", "name", "slug", "url", "serials.high", "image", "kind")


@query(f"SELECT l_orderkey AS page_id, 'group ' || (l_linenumber % 2) AS grp, 'd' || l_partkey AS drawing, p_name AS title, p_type AS description, lpad(l_suppkey::VARCHAR, 5, '0') AS low, '/d/' || l_partkey AS url {LINES}")
def s11_model_drawings(spark, d):
    n, k, _ = keys()
    entry = said("<li class='go_to_schema' data-schemaurl='http://h/d/", k, "'><b class='schema-title'>d", k, "</b><i class='schema-subtitle'>", F.col("p_name"), "</i><p class='long-description'>", F.col("p_type"), "</p><div class='schema-description'><i class='schema-serialdata'>sn: ", F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), "→</i></div></li>")
    panel = said("<div class='panel'><h4 class='panel-title'><a>group ", n % 2, " <i class='badge'>1</i></a></h4><ul>", entry, "</ul></div>")
    pages = lines_of_orders(spark, d, panel, head="<h2><b class='label'>m</b> model</h2><div id='schemes-accordion'>", tail="</div>")
    return C.model_drawings(nodes_of(pages, paths=True)).select("page_id", "grp", "drawing", "title", "description", "serials.low", "url")


@query("SELECT o_orderkey AS page_id, 'S' || o_custkey AS label, o_orderpriority AS name FROM orders")
def s11_model_heads(spark, d):
    pages = load(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), said("<title>x - tQuadra</title><h2><b class='label'>S", F.col("o_custkey"), "</b> ", F.col("o_orderpriority"), "</h2><h2>no</h2>").alias("html"))
    return C.page_heads(nodes_of(pages))


def drawing_pages(spark, d):
    n, k, o = keys()
    serials = F.when(n % 3 == 0, said(k, " <i class='arrow-right'></i>")).when(n % 3 == 1, said("<i class='arrow-right'></i>", k)).otherwise("mt")
    code = F.when(n % 5 == 0, "00000000").otherwise(said("C", k))
    row = said("<tr><td class='colnumero'>", n, "<td class='colcodice'>", code, "<td class='coltitolo'>", F.col("p_name"), "<td class='colserials'>", serials, "<td class='extra'>", F.col("p_type"), "<td class='colminqta'>q. ", n, " pz</tr>")
    point = said("<tr><td><div id='at", n, "'></div></tr>")
    pages = lines_of_orders(spark, d, row, point)
    head = said("<script>imgWidth = ", 100 + o % 7, "; imgHeight='50'</script><div id='schema-title'><b class='schema-title'>a", o, "</b><h2>Drawing ", o, "</h2><i id='schema_validity_label'>", o, "→</i></div><div id='pngdata' style=\"background: url('/imageserver/b/files/", o, ".png')\"><a class='clickablePoint' data-label=' ", o % 9, " ' data-left='", o % 5, ".5' data-top='2' data-width='x'></a></div><div id='otherproducts'><figure class='schemafigure'><b class='schema-title'>s", o, "</b><b class='schema-subtitle'>S</b></figure></div><table id='spare_parts_table'><tr><th>Codice</tr>")
    return pages.select("page_id", F.concat(head, F.col("html"), F.lit("</table>")).alias("html"))


@query(f"""SELECT l_orderkey AS page_id, l_linenumber::VARCHAR AS position, CASE WHEN l_linenumber % 5 = 0 THEN '00000000' ELSE 'C' || l_partkey END AS code, p_name AS description, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey::VARCHAR END AS low,
  CASE WHEN l_linenumber % 3 = 1 THEN l_partkey::VARCHAR END AS high, CASE WHEN l_linenumber % 3 = 2 THEN 'mt' ELSE '' END AS remark, p_type AS info, l_linenumber::BIGINT AS quantity, l_linenumber % 5 <> 0 AS supplied {LINES}""")
def s11_drawing_parts(spark, d):
    return C.drawing_parts(nodes_of(drawing_pages(spark, d))).select("page_id", "position", "code", "description", "serials.low", "serials.high", "remark", "info", "quantity", "supplied")


@query(f"""SELECT DISTINCT l_orderkey AS page_id, 'a' || l_orderkey AS drawing, 'Drawing ' || l_orderkey AS title, l_orderkey::VARCHAR AS low, 's' || l_orderkey AS model, 'http://site/files/' || l_orderkey || '.png' AS url, 100 + l_orderkey % 7 AS width, 50::BIGINT AS height,
  (l_orderkey % 9)::VARCHAR AS position, l_orderkey % 5 + 0.5::DOUBLE AS x, 2::DOUBLE AS y, NULL::DOUBLE AS point_width {LINES}""")
def s11_drawing_heads(spark, d):
    pages = N.page_arrays(drawing_pages(spark, d).withColumns(C.image_sizes()), "width", "height")  # each page is read once for all that is asked of it
    said = {"head": C.head_of_drawing(), "url": C.image_of_drawing(SITE), "points": C.points_of_drawing(), "models": C.models_of_drawing()}
    found = pages.select("page_id", "width", "height", *[c.alias(k) for k, c in said.items()]).where("url <> ''").withColumn("point", F.explode("points")).withColumn("model", F.explode("models"))
    return found.select("page_id", "head.drawing", "head.title", arrow_interval(F.col("head.serial")).getField("low").alias("low"), "url", "width", "height", "point.position", "point.x", "point.y", F.col("point.width").alias("point_width"), F.col("model.slug").alias("model"))


@query(f"SELECT l_orderkey AS page_id, 'd' || l_partkey AS drawing, 'm-' || l_suppkey AS model, l_linenumber::VARCHAR AS high {LINES}")
def s11_code_drawings(spark, d):
    n, k, _ = keys()
    entry = said("<li class='go_to_schema'><b class='schema-title'>d", k, "</b><ul class='model-list'><li>m-", F.col("l_suppkey"), " <i class='schema-serialdata'>(-> ", n, ")</i></li></ul></li>")
    nodes = nodes_of(lines_of_orders(spark, d, entry, head="<h2><b class='label'>C</b> code</h2><ul>", tail="</ul>"))
    entries = F.transform(N.of_page(C.is_entry), lambda x: F.struct(C.entry_of(x)["drawing"].alias("drawing"), C.models_in(x).alias("models")))
    models = N.each(nodes, entries).select("page_id", "drawing", F.inline("models"))
    return C.read_models(models, "drawing").select("page_id", "drawing", F.col("slug").alias("model"), "serials.high")


@query("SELECT p_partkey AS page_id, 'C' || p_partkey AS code, p_name AS description, 'A' || p_size || ',' || p_type AS previous FROM part")
def s11_code_heads(spark, d):
    pages = load(spark, d, "part").select(F.col("p_partkey").alias("page_id"), said("<h2><b class='label'>C", F.col("p_partkey"), "</b> ", F.col("p_name"), "</h2><small>x</small><small>Codice precedente: A", F.col("p_size"), "; ", F.col("p_type"), "</small>").alias("html"))
    return C.code_heads(nodes_of(pages)).select("page_id", "code", "description", F.array_join("previous", ",").alias("previous"))


@query(f"SELECT l_orderkey AS page_id, 'C' || l_partkey AS code, p_name AS description, 'A' || l_linenumber || ',B' || l_suppkey AS previous {LINES}")
def s11_search_codes(spark, d):
    n, k, _ = keys()
    pages = lines_of_orders(spark, d, "<tr><td>C", k, "<td>", F.col("p_name"), "<td>A", n, "; B", F.col("l_suppkey"), "</tr><tr><td>short</tr>", head="<table><tr><th>Codice</tr><tr><td>a<td>b<td>c</table><div id='mainwrapper'><table><tr><th>Codice</tr>", tail="</table></div>")
    return C.code_results(nodes_of(pages)).select("page_id", "code", "description", F.array_join("previous", ",").alias("previous"))


@query(PRODUCT_SQL)
def s11_search_models(spark, d):
    return s11_products(spark, d)


@query(f"SELECT l_orderkey AS page_id, p_name AS series, l_partkey::VARCHAR AS high, 'm' || l_suppkey AS machine, 's' || l_linenumber AS serial, p_type AS model, '/m/' || l_partkey AS url, CASE WHEN l_linenumber % 2 = 0 THEN lpad(l_linenumber::VARCHAR, 5, '0') END AS number {LINES}")
def s11_search_serials(spark, d):
    n, k, _ = keys()
    asked = F.when(n % 2 == 0, said("?validateserialnumber=", F.lpad(n.cast("string"), 5, "0"), "&x")).otherwise("")
    pages = lines_of_orders(spark, d, "<tr><td>", F.col("p_name"), " (-> ", k, ")<td>m", F.col("l_suppkey"), "<td>s", n, "<td><a href='http://h/m/", k, asked, "'>", F.col("p_type"), "</a></tr>", head="<section class='result_list'><table><tr><th>Matricola</tr>", tail="</table></section>")
    return C.serial_results(nodes_of(pages)).select("page_id", "series", "series_serials.high", "machine", "serial", "model", "url", "number")


@query(f"SELECT l_orderkey AS page_id, 'd' || l_partkey AS drawing, p_name AS title, p_type AS grp, '/d' || l_partkey AS url {LINES}")
def s11_search_drawings(spark, d):
    n, k, _ = keys()
    pages = lines_of_orders(spark, d, "<tr><td>", n, "<td>d", k, "<td>", F.col("p_name"), "<td>", F.col("p_type"), "</tr>", head="<section class='result_list'><table><tr><th>Gruppo</tr>", tail="</table></section>")
    return C.drawing_results(nodes_of(pages)).drop("place")


@query(f"SELECT l_orderkey AS page_id, max(l_linenumber)::BIGINT AS pages {LINES} GROUP BY 1")
def s13_pager_count(spark, d):
    n, _, _ = keys()
    return C.page_counts(nodes_of(lines_of_orders(spark, d, "<li><a href='?p=", n, "'>", n, "</a></li>", head="<li>99</li><ul class='pagination'>", tail="<li>&raquo;</li></ul>")))


@query(f"SELECT DISTINCT l_orderkey AS page_id, '/c?p=' || l_partkey AS url {LINES}")
def s13_pager_links(spark, d):
    n, k, _ = keys()
    return C.page_links(nodes_of(lines_of_orders(spark, d, "<li><a href='http://h/c?p=", k, "#x'>", n, "</a></li>", head="<ul class='pagination'><a href='#'>1</a>", tail="<a href='javascript:x'>x</a></ul>"))).drop("place")
