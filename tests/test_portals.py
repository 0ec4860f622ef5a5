"""Old drawings line by line: which serial numbers and which texts count."""

import pytest

from quarry.sources import portals as P
from quarry.sources.federation import federated, open_sources

SCHEMA = "page_id long, html string"


def line(text, drawing=201):
    return f"{text}<br/>\n<!-- {drawing} -->\n"


PAGE = "".join([
    line('1 <a href="x?CODICE=AB1&l=1">AB1</a> bolt (2)  long (3)'), line("A123456 before any validity"), line("VALIDO FINO ALLA MACCHINA"), line("(2)"), line("until A11111 x"), line("B22222 is the note's text"),
    line("(3) own text"), line("not its text"), line("VALIDA DALLA MACCHINA"), line("VALIDO FINO AL MACCHINA"), line("C3333333"), line("(2)"), line("later text"), line("(9) of no drawing", 305),
])


def rows_of(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


def test_old_drawings(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>no lines")], SCHEMA)
    assert rows_of(P.old_parts(pages)) == [(1, 0, "201", "1", "AB1", "bolt long", ("2", "3"))]
    assert rows_of(P.old_notes(pages)) == [(1, "201", "2", "later text"), (1, "201", "3", "own text")]
    assert rows_of(P.old_validity(pages)) == [(1, "201", "C3333333", "A11111", "until A11111 x C3333333")]
    assert rows_of(P.old_headers(pages)) == []


def test_pages_of_an_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    for read in (P.old_parts, P.old_notes, P.old_validity, P.old_headers, P.releases, P.viewer, P.clickable_positions, P.parts_master, P.attachments):
        assert read(pages).collect() == []


def test_sources_that_do_not_open_are_left_out(spark):
    one = lambda: spark.createDataFrame([(1, "a")], "code long, name string")
    two = lambda: spark.createDataFrame([("b",)], "name string")
    missing = lambda: one().select("no_such_column")
    rows = {(r["brand"], r["code"], r["name"]) for r in federated({"x": one, "y": missing, "z": two}).collect()}
    assert rows == {("x", 1, "a"), ("z", None, "b")}
    assert set(open_sources({"y": missing})[1]) == {"y"}
    with pytest.raises(ValueError):
        federated({"y": missing})


def test_what_follows_the_last_line_is_read_once(spark):
    """A long page without line ends behind its lines: before, each of its characters began a search to its end."""
    import time

    html = '1 <a href="x?CODICE=7&l=1">7</a> bolt (2)<br><!-- 201 -->\n(2) note<br><!-- 201 -->' + "x" * 400_000
    began = time.time()
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [tuple(r) for r in P.old_parts(pages).select("drawing", "position", "code", "description", "notes").collect()] == [("201", "1", "7", "bolt", ["2"])]
    assert time.time() - began < 30
