"""Pages of portals: each query writes its pages from the tables, as portals do, and its SQL reads the rows they were made from."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.shared import dealt
from quarry.registry import query
from quarry.sources import portals as P
from quarry.sources.federation import federated
from quarry.sources.tables import load

# An order may have several lines of one number; on its page they are numbered on.
NUMBERED = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS l_linenumber, l_partkey, l_suppkey FROM lineitem"
LINES = f"FROM ({NUMBERED}) JOIN part ON p_partkey = l_partkey"
DRAWING = "'20' || (1 + l_linenumber // 4)"
SERIAL = "'A' || (100000 + l_partkey % 900000)"


def lines_of_orders(spark, d, *mark, head="", tail=""):
    """One page an order; mark is what each of its lines is on the page."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    numbered = dealt(load(spark, d, "lineitem"), "l_orderkey").select("l_orderkey", place.alias("l_linenumber"), "l_partkey", "l_suppkey")
    rows = numbered.join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m.cast("string") for m in mark])
    # few bytes a page, and much to read in them: all tasks have some, though they would fit into one. Texts are written where their page is
    pages = dealt(rows, "l_orderkey").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("t")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["t"]), "")
    html = F.concat(F.lit(head), body, F.replace(F.lit(tail), F.lit("{page}"), F.col("page_id").cast("string")))
    return pages.select("page_id", html.alias("html"))


def old_pages(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    end = F.concat(F.lit("<br><!-- 20"), F.floor(1 + n / 4).cast("string"), F.lit(" -->\n"))
    serial = F.concat(F.lit("see <b>A"), (100000 + k % 900000).cast("string"), F.lit("</b> x"), end)
    validity = F.when(n % 4 == 1, F.concat(F.lit("VALIDO FINO ALLA MACCHINA"), end, serial)).when(n % 4 == 2, F.concat(F.lit("valida dalla macchina"), end, serial)).otherwise("")
    note = F.concat(F.lit("("), n.cast("string"), F.lit(") "), F.when(n % 3 == 0, F.concat(end, F.col("p_type"))).otherwise(F.col("p_type")), end)
    part = F.concat(n.cast("string"), F.lit(' <a href="x.asp?CODICE=P'), k.cast("string"), F.lit('&l=1">P</a> '), F.col("p_name"), F.lit(" ("), n.cast("string"), F.lit(") "), end)
    header = "<table><tr><td>x</td></tr><tr><td><img src='i{page}.gif'>MACH {page}<br>two<br>mod a</td><td>Title&nbsp;{page}</td><td>GR TAV 20 1 01.2020</td></tr></table>"
    return lines_of_orders(spark, d, part, note, validity, head="<html>POS MATRIC\n", tail=header)


@query(f"SELECT l_orderkey AS page_id, {DRAWING} AS drawing, l_linenumber::VARCHAR AS position, 'P' || l_partkey AS code, p_name AS description, l_linenumber::VARCHAR AS notes {LINES}")
def s8_old_parts(spark, d):
    return P.old_parts(old_pages(spark, d)).select("page_id", "drawing", "position", "code", "description", F.array_join("notes", ",").alias("notes"))


@query(f"SELECT l_orderkey AS page_id, {DRAWING} AS drawing, l_linenumber::VARCHAR AS note, p_type AS text {LINES}")
def s8_old_notes(spark, d):
    return P.old_notes(old_pages(spark, d))


@query(f"""SELECT l_orderkey AS page_id, {DRAWING} AS drawing, coalesce(arg_max({SERIAL}, l_linenumber) FILTER (l_linenumber % 4 = 2), '') AS valid_from, coalesce(arg_max({SERIAL}, l_linenumber) FILTER (l_linenumber % 4 = 1), '') AS valid_to,
  string_agg('see ' || {SERIAL} || ' x', ' ' ORDER BY l_linenumber) AS validity_text {LINES} WHERE l_linenumber % 4 IN (1, 2) GROUP BY 1, 2""")
def s8_old_validity(spark, d):
    return P.old_validity(old_pages(spark, d))


@query(f"SELECT DISTINCT l_orderkey AS page_id, {DRAWING} AS drawing, 'MACH ' || l_orderkey || ' two' AS machine, 'mod a' AS models, 'Title ' || l_orderkey AS title, '01.2020' AS date, 'i' || l_orderkey || '.gif' AS image {LINES} AND l_linenumber < 4")
def s8_old_headers(spark, d):
    return P.old_headers(old_pages(spark, d))


@query("SELECT s_suppkey AS page_id, CASE s_suppkey % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'new' WHEN 2 THEN 'group' ELSE 'none' END AS format FROM supplier")
def s10_drawing_format(spark, d):
    k = F.col("s_suppkey") % 4
    old = 'POS MATRIC\n1 <a href="x?CODICE=7&l=1">7</a> bolt <br><!-- 201 --> pos. <tr>'
    html = F.when(k == 0, old).when(k == 1, "<tr><td>Pos.</td><td>Matric.</td><td><a href='x?codice=7'>7</a>").when(k == 2, "<p>Tavole componenti il gruppo").otherwise("<p>POS. MATRIC")
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), P.drawing_format(html).alias("format"))


@query(f"SELECT l_orderkey AS page_id, l_partkey::BIGINT AS release, p_name AS description, p_type AS document, 'r' || l_linenumber AS date {LINES}")
def s12_releases(spark, d):
    k = F.col("l_partkey")
    pages = lines_of_orders(spark, d, "<TR onclick='openSelectedRelease(", k, ")'><td>&nbsp;</td><td>", F.col("p_name"), "</td><td><b>", F.col("p_type"), "</b></td><td>r", F.col("l_linenumber"), "</td><td>&gt;</td></TR>", head="<table><tr><td>Release</td></tr>", tail="</table>")
    return P.releases(pages).select("page_id", "release", "description", "document", "date")


@query(f"SELECT l_orderkey AS page_id, 'D-' || l_orderkey AS folder, l_partkey::BIGINT AS drawing, l_linenumber::VARCHAR AS number, CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE p_name || ' - b' END AS title {LINES}")
def s12_viewer(spark, d):
    n = F.col("l_linenumber")
    said = F.when(n % 2 == 0, F.concat(F.lit(" tabledescription='"), F.col("p_type"), F.lit("'"))).otherwise("")
    pages = lines_of_orders(spark, d, "<div class='t' tableid='", F.col("l_partkey"), "'", said, ">", n, " - ", F.col("p_name"), " - b</div>", tail="<script>x({dir: 'D-{page}'})</script>")
    return P.viewer(pages).select("page_id", "folder", "drawing", "number", "title")


@query(f"SELECT l_orderkey AS page_id, l_partkey::BIGINT AS product, 't' || l_linenumber AS tab, l_suppkey::BIGINT AS row, 'n' || l_linenumber AS label {LINES}")
def s12_positions(spark, d):
    n = F.col("l_linenumber")
    click = F.concat(F.lit("onclick=\"openDialogSVG("), F.col("l_partkey").cast("string"), F.lit(", 't"), n.cast("string"), F.lit("', "), F.col("l_suppkey").cast("string"), F.lit(")\""))
    pages = lines_of_orders(spark, d, "<text ", click, "><tspan>n", n, "</tspan></text><text x='1'>no</text><text ", click, ">again</text>", head="<svg>", tail="</svg>")
    return P.clickable_positions(pages)


@query("SELECT p_partkey // 40 AS page_id, 'P' || p_partkey AS code, p_brand AS company, p_name AS description, CASE p_partkey % 3 WHEN 0 THEN 'R' || p_partkey END AS replaced_by, p_partkey % 3 = 1 AS dismissed, CASE WHEN p_partkey % 5 > 0 THEN 1234.5::DOUBLE END AS least, p_size::DOUBLE AS weight, 'http://x/' || p_partkey || '.jpg' AS photo FROM part")
def s12_parts_master(spark, d):
    k = F.col("p_partkey")
    new = F.when(k % 3 == 0, F.concat(F.lit("R"), k.cast("string"))).when(k % 3 == 1, "$Dismissed 2019").otherwise("&nbsp;")
    cells = [F.concat(F.lit("<a href=\"javascript:openImage('it\\'s', '/"), k.cast("string"), F.lit(".jpg')\">f</a>")), F.col("p_brand"), F.concat(F.lit("P"), k.cast("string")), F.col("p_name"), new, F.when(k % 5 > 0, "1.234,50").otherwise("n/a"), F.col("p_size").cast("string"), F.lit("d")]
    row = F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td class='g wGridRow01'>"), c, F.lit("</td>"))], F.lit("</tr><tr><td class='wGridRow01'>short</td></tr>"))
    pages = load(spark, d, "part").groupBy(F.floor(k / 40).alias("page_id")).agg(F.array_join(F.collect_list(row), "").alias("html"))
    return P.parts_master(pages, "http://x").drop("place")


@query(f"SELECT l_orderkey AS page_id, p_name AS name, CASE WHEN l_linenumber % 2 = 0 THEN '/w' ELSE '/a' END || l_partkey AS url, 'PDF' AS kind, l_linenumber || ',5 MB' AS size, p_type AS note {LINES}")
def s11_attachments(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    opened = F.when(n % 2 == 0, F.concat(F.lit(" onclick=\"window.open('/w"), k, F.lit("')\""))).otherwise("")
    pages = lines_of_orders(spark, d, "<article class='singledocument'", opened, "><h3>", F.col("p_name"), "</h3><a href='/a", k, "'>open</a><div class='doc_info'>Tipo: PDF <br>Dimensione : ", n, ",5 MB</div><p class='doc_abstract'>", F.col("p_type"), "</p></article>", head="<section class='attachment'>")
    return P.attachments(pages).drop("place")


@query("SELECT 'parts' AS brand, p_partkey AS code, p_name AS name, p_size AS size, NULL::VARCHAR AS phone FROM part UNION ALL SELECT 'makers', s_suppkey, s_name, NULL, s_name || '-1' FROM supplier")
def s19_federated(spark, d):
    parts = lambda: load(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    makers = lambda: load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("code"), F.concat("s_name", F.lit("-1")).alias("phone"))
    broken = lambda: load(spark, d, "part").select("no_such_column")
    return federated({"parts": parts, "broken": broken, "makers": makers})
