"""The node table, and drawings in the new format, against literal rows."""

import pytest
from pyspark.sql import functions as F

from quarry.sources import drawings as D
from quarry.sources import nodes as N

PAGES = "page_id long, url string, html string"


def rows_of(df, *columns):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect()), key=repr)


def test_nodes_close_as_browsers_do(spark):
    html = "<ul><li>a<li>b<ul><li>c</ul></ul><p>one<p>two<table><tr><td>x<td>y<tr><th>z<table><tr><td>in</td></tr></table></th></table><br><img src=i></i></div><b>open"
    nodes = N.page_nodes(spark.createDataFrame([(1, "", html), (2, "", None), (3, "", "")], PAGES)).collect()
    assert {n.page_id for n in nodes} == {1}
    at = {n.enter: n for n in nodes}
    shown = lambda n: "/".join(at[p].tag for p in n.path[1:]) + "/" + (n.text or n.tag)
    texts = [shown(n) for n in sorted(nodes, key=lambda n: n.enter) if n.tag == "#text"]
    assert texts == ["ul/li/a", "ul/li/b", "ul/li/ul/li/c", "p/one", "p/two", "table/tr/td/x", "table/tr/td/y", "table/tr/th/z", "table/tr/th/table/tr/td/in", "b/open"]
    for n in nodes:  # what is in an element's interval has it in its path
        assert [m.enter for m in nodes if n.enter < m.enter <= n.leave] == [m.enter for m in nodes if n.enter in m.path]


def test_selections(spark):
    html = '<div class="a b"><p>  x\n y <i>z</i></p><div class="a"><p></p><script>not this</script>t&amp;u</div></div><p class="ab">q</p>'
    nodes = N.page_nodes(spark.createDataFrame([(1, "", html)], PAGES))
    outer = N.chosen(nodes, N.has_class("a"), "d")
    assert rows_of(N.texts(nodes, outer, "d"), "d", "text") == [(1, "x y z t&u"), (6, "t&u")]
    assert rows_of(N.outermost(nodes, outer, "d"), "d") == [(1,)]
    ps = N.under(nodes, N.is_tag("p"), outer, "d", "p")
    assert rows_of(ps, "d", "p") == [(1, 2), (1, 7), (6, 7)]
    assert rows_of(N.first(ps, ["page_id", "d"], "p"), "d", "p") == [(1, 2), (6, 7)]
    assert rows_of(N.first(ps, ["page_id", "d"], "p", last=True), "d", "p") == [(1, 7), (6, 7)]
    assert rows_of(N.nearest(nodes, N.chosen(nodes, N.is_tag("p"), "p"), "p", N.has_class("a"), "d"), "p", "d") == [(11, None), (2, 1), (7, 6)]


def part(pos, code, description, quantity="1"):
    return f"<tr><td>{pos}</td><td><a href='x.asp?l=1&amp;CODICE={code}&z=2'>{code}</a></td><td>{description}</td><td>{quantity}</td></tr>"


def line(text):
    return f"<tr><td></td><td colspan=3>{text}</td></tr>"


LIST = "<table><tr><th>Pos.</th><th>Matricola</th></tr>{}</table>"
FIRST = LIST.format(part("3-4", "AB1", "bolt (2) long (3) -") + part("see", "AB2", "- nut")) + LIST.format(
    line("A123456 before any validity") + line("VALIDO FINO ALLA MACCHINA") + line("(2)") + line("until A11111 x") + line("B22222 is the note's text") + line("(3) own text") + line("not its text")
    + line("VALIDA DALLA MACCHINA C3333333") + line("D444444 too late") + line("(2)") + line("later text") + part("7", "AB3", "ring", "")
)
PAGE = f"""<html><body><a name="10_01_C"></a><table class=outer><tr><td><h2>MACHINE Q</h2><h2 class=C>20_02_C</h2>GR TAV <p>30 / 40 S</p><p>MACHINE Q</p><p>50/60</p><p>GEAR BOX</p>
<img src="other.gif"><img class="tav" src="../i/d.gif"> 02.2019 03.2020 {FIRST}</td></tr></table>
<table><tr><td>gr <b>tav</b> {LIST.format(part("1", "CD1", "x"))}</td></tr></table><table><tr><td>GR TAV without parts</td></tr></table><table><tr><td>no drawing {LIST.format(part("1", "NO", "x"))}</td></tr></table></body></html>"""


def test_new_drawings(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b/p.html?x=1", PAGE), (2, "", None), (3, "", "<p>nothing"), (4, "http://h/30_01_A.html", LIST.format(part("1", "E", "whole page")))], PAGES)
    found = D.NewDrawings(pages)
    assert rows_of(found.parts(), "page_id", "drawing", "position", "code", "description", "quantity", "notes") == [
        (1, "10_01_C", "1", "CD1", "x", "1", ()),
        (1, "20_02_C", "", "AB2", "nut", "1", ()),
        (1, "20_02_C", "3-4", "AB1", "bolt long", "1", ("2", "3")),
        (1, "20_02_C", "7", "AB3", "ring", "", ()),
        (4, "30_01_A", "1", "E", "whole page", "1", ()),
    ]
    assert rows_of(found.notes(), "page_id", "drawing", "note", "text") == [(1, "20_02_C", "2", "later text"), (1, "20_02_C", "3", "own text")]
    assert rows_of(found.validity(), "page_id", "drawing", "valid_from", "valid_to", "validity_text") == [(1, "20_02_C", "C3333333", "A11111", "VALIDO FINO ALLA MACCHINA until A11111 x VALIDA DALLA MACCHINA C3333333")]
    assert rows_of(found.headers(), "page_id", "drawing", "grp", "number", "machine", "models", "title", "date", "image") == [
        (1, "10_01_C", "10", "01_C", "", "", "", "", ""),
        (1, "20_02_C", "20", "02_C", "MACHINE Q", "30 / 40 S", "GEAR BOX", "02.2019", "http://h/a/i/d.gif"),
        (4, "30_01_A", "30", "01_A", "", "", "", "", ""),
    ]


def test_group_index(spark):
    html = "<table><tr><td><a class=grup href='t/20_01_B.html#x'>01_B</a></td><td>first</td><td>The <b>title</b></td></tr><tr><td><a class='x grup' href='t/20_01_B.html'>again</a></td></tr><tr><td><a class=grup href='/other.html'>02_A</a></td></tr></table><a class=grup href=z.html>z</a><a href='y'>no</a>"
    pages = spark.createDataFrame([(1, "http://h/g/grup20.html", html)], PAGES)
    assert rows_of(D.group_drawings(N.page_nodes(pages), pages), "drawing", "label", "title", "url") == [
        ("02_A", "02_A", "02_A", "http://h/other.html"),
        ("20_01_B", "01_B", "The title", "http://h/g/t/20_01_B.html"),
        ("z", "z", "", "http://h/g/z.html"),
    ]


@pytest.mark.parametrize("link,want", [("x.gif", "http://h/a/x.gif"), ("/x", "http://h/x"), ("../../x", "http://h/x"), ("//o/x", "http://o/x"), ("ftp://o/x", "ftp://o/x"), ("", "http://h/a/b?c/d"), ("./y/../x", "http://h/a/x")])
def test_absolute(spark, link, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(D.absolute(F.lit("http://h/a/b?c/d"), F.lit(link))).first()[0] == want


def test_settled_nodes_stay_where_their_page_is(spark):
    """Selections over settled nodes move none of them, and many pages go out in one batch."""
    pages = spark.createDataFrame([(i, "", f"<div class='a'><p>one {i}</p><p>two</p></div>") for i in range(300)] + [(300, "", None)], PAGES)
    nodes = N.settled_nodes(pages)
    assert rows_of(nodes, "page_id", "enter", "text") == rows_of(N.page_nodes(pages), "page_id", "enter", "text")
    found = N.first(N.texts(nodes, N.under(nodes, N.is_tag("p"), N.chosen(nodes, N.has_class("a"), "div"), "div", "p"), "p", "said"), ["page_id", "div"], "p", "said")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert rows_of(found, "said") == sorted(((f"one {i}",) for i in range(300)), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plain_pages_are_read_as_html_parser_reads_them():
    """The one pattern for plain markup gives HTMLParser's nodes, or leaves the page to it."""
    import itertools

    pieces = ["<p>", "</p>", "<td class='a b'>", "<table id=x>", "</table>", "a &amp; b", " ", "&nbsp", "<!-- c -->", "<!--->", "<br/>", "<a href='?l=1&amp;c=2'>", "<A HREF=\"u\" disabled>", "<script>1 & 2</script>", "<script>a<b</script>", "<title>q &lt;", "</title>", "<", "<x-y>", "<td\x0bclass=x>", "<textarea>"]
    read = 0
    for cut in itertools.product(pieces, repeat=3):
        html = "".join(cut)
        slow, fast = N._Nodes(), N._Nodes()
        slow.feed(html)
        slow.close()
        if fast.read(html):
            read += 1
            assert fast.nodes == slow.nodes, html
    assert read > 1000


def test_page_arrays_need_no_shuffle_and_no_table(spark):
    """Selections over a page's array deal, sort and settle nothing; long pages and null pages among them."""
    from quarry.sources import catalog_pages as C

    rows = "".join(f"<tr><td>{i}<td>d{i}<td>t <b>{i}</b><td>g</tr>" for i in range(3000))
    page = f"<section class='result_list'><table><tr><th>no</table><table><tr><th>Gruppo</tr>{rows}</table></section>"
    pages = spark.createDataFrame([(1, "", page), (2, "", None), (3, "", ""), (4, "", "<p>x")], PAGES)
    arrays = N.page_arrays(pages, "url")
    assert rows_of(arrays.select("page_id", F.size("nodes").alias("n")), "page_id", "n") == [(1, len(N.read_page(page))), (4, 3)]
    found = C.drawing_results(arrays)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found, "drawing", "title") == sorted(((f"d{i}", f"t {i}") for i in range(3000)), key=repr)


def test_new_drawings_move_no_page(spark):
    """Parts are read page by page without a shuffle; notes deal rows once."""
    pages = spark.createDataFrame([(i, "http://h/30_01_A.html", PAGE) for i in range(3)] + [(3, "", None)], PAGES)
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = D.NewDrawings(pages)
    assert "Exchange" not in planned(found.parts()) and "Exchange" not in planned(found.headers())
    assert planned(found.notes()).count("Exchange") == 1
    assert found.parts().count() == 12 and found.notes().count() == 6


def test_equal_rows_are_judged_once():
    """What tags close and open is found once for each state of the open elements, and the lists that nodes share are written once."""
    rows = "".join(f"<tr><td class='a b'>{i}<td><a class=c>x</a></tr>" for i in range(3000))
    reader = N.page_reader()
    reader.add(f"<table id=t>{rows}</table>")
    reader.add(f"<table id=t>{rows}</table>")
    assert len(reader.moves) < 20 and len(reader.lists["around"]) < 10 and len(reader.lists["classes"]) == 3
    arrays = reader.taken()
    assert len(arrays[0]) == 2 * (2 + 6 * 3000) and arrays[3][6].as_py() == ["#page", "table", "#t", "tr", "td"] and reader.nodes == []


def test_values_with_references_are_read_as_html_parser_reads_them():
    """An ampersand in a quoted value leaves its page plain, and equal shapes of markup are judged once for all values."""
    import itertools

    values = ["", "x.asp?l=1&amp;C=P", "a&b", "a&copy;b&copy=1&#65;&lt", "a=b", "x\0", "it"]
    shapes = ["<a href='{}'>", '<a href="{}" name=n>', "<p class='{}' id=\"{}\">", "<td class='k' id=q title='{}' lang='{}'>", "<i a='{}' a='{}' b>", "<b\tA='{}'\n>", "<p a='{}'b='x'>", "<p a=it's b=it's>", "<p a=\"it's\" b='{}'>"]
    read = 0
    for shape, one, two in itertools.product(shapes, values, values):
        html = shape.replace("{}", one, 1).replace("{}", two) * 2 + "x</p>y"
        slow, fast = N._Nodes(), N._Nodes()
        slow.feed(html)
        slow.close()
        if fast.read(html):
            read += 1
            assert fast.nodes == slow.nodes, html
    assert read > 250
    reader = N.page_reader()
    reader.feed = None  # HTMLParser is not asked
    for i in range(50):
        reader.add(f"<table>{''.join(f"<tr><td><a href='x.asp?l={i}&amp;CODICE={j}&z'>P</a>" for j in range(50))}</table>")
    assert len(reader.shapes) == 1 and reader.nodes[4][6] == (("href", "x.asp?l=0&CODICE=0&z"),)


def test_nodes_of_new_drawings_stay_where_they_are_read(spark):
    """What a page's drawings are made of is selected in the walk over it: no plan carries nodes, and many pages are read by one reader."""
    pages = spark.createDataFrame([(i, "http://h/30_01_A.html", PAGE if i % 2 else f"<p x='&'>{i}") for i in range(300)], PAGES)
    found = D.NewDrawings(pages)
    for df, rows in ((found.parts(), 600), (found.notes(), 300), (found.validity(), 150), (found.headers(), 300)):
        assert "nodes" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == rows


def test_indexes_settle_no_node_table(spark):
    """Both indexes are read from a page's array: one shuffle, of the rows found; links of one row, nested rows and links without a row among them."""
    from quarry.sources import catalog_pages as C

    group = "<table><tr><td><a class=grup href=1.html>1</a><td>t<table><tr><td><a class=grup href=2.html>2</a><td>in</table><tr><td><a class=grup href=3.html>3</a><a class=grup href=4.html>4</a><td>last</table><a class=grup href=5.html>5</a><a class=grup>6</a>"
    cells = "".join(f"<td>{c}" for c in ("S", "P", "-", "B"))
    index = f"<table><tr><td><a href='x'></a><a href='cat/a/index.html'>o</a>{cells}<tr><td><a href='cat/few/index.html'>o</a><tr><td><a href='cat/a/index.htm'>o</a>{cells}<tr><td><table><tr><td><a href='/cat/in/index.html'>o</a>{cells}</table></table><a href='cat/b/index.html'>"
    pages = spark.createDataFrame([(1, "http://h/g/x.html", group), (2, "http://h/g/x.html", index), (3, "", None)], PAGES)
    for nodes in (N.page_arrays(pages, "url", paths=True), N.page_nodes(pages)):
        found = D.group_drawings(nodes, pages)
        assert rows_of(found, "label", "title") == [("1", "in"), ("2", "in"), ("3", "last"), ("4", "last"), ("5", "")]
        codes = C.catalog_index(nodes, pages)
        assert rows_of(codes, "code", "url", "series") == [("a", "http://h/g/cat/a/index.html", "S"), ("in", "http://h/cat/in/index.html", "S")]
    arrays = N.page_arrays(pages, "url", paths=True)
    for df in (D.group_drawings(arrays, pages), C.catalog_index(arrays, pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "settled" not in plan
