"""Files in and out: synonym lists, texts of pages in two encodings, spreadsheets, swapped partitions; and blocks of a search's answer."""

import random

from pyspark.sql import functions as F

from quarry.operators import merge, resolve, search
from quarry.sources import catalog_pages as C
from quarry.sources import documents as D
from quarry.sources import nodes as N


def test_synonym_list(spark, tmp_path):
    (tmp_path / "s.csv").write_text("termine_preciso;termini_impropri\nanello di tenuta;guarnizione; paraolio \nvite;;\n", encoding="utf-8")
    (tmp_path / "q.csv").write_text('precise;improper\nfiltro;"tappo; cartùccia;;"\n', encoding="utf-8")
    assert sorted(tuple(r) for r in D.synonym_list(spark, str(tmp_path / "q.csv")).collect()) == [("cartùccia", "filtro"), ("tappo", "filtro")]


def test_page_texts_in_three_encodings(spark, tmp_path):
    (tmp_path / "manual_a_001.txt").write_bytes("﻿è utf".encode())
    (tmp_path / "manual_a_012.txt").write_bytes("è windows – “dash”".encode("cp1252"))
    (tmp_path / "manual_a_013.txt").write_bytes("è latin \x81\x96".encode("latin-1"))
    (tmp_path / "other.txt").write_text("no page")
    (tmp_path / "empty_2.txt").write_text("")
    found = D.page_texts(spark, str(tmp_path)).orderBy("document", "page").collect()
    assert [tuple(r) for r in found] == [("manual_a", 1, "è utf"), ("manual_a", 12, "è windows – “dash”"), ("manual_a", 13, "è latin \x81\x96")]


def test_export_for_spreadsheets(spark, tmp_path):
    merge.export_csv(spark.createDataFrame([(1, "a;b"), (2, "è")], "id long, name string").coalesce(1), f"{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert part == '﻿id;name\n1;"a;b"\n2;è\n'.encode()


def test_write_partitions_swaps_those_it_holds(spark, tmp_path):
    at = f"{tmp_path}/t"
    merge.write_partitions(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p long, x string"), at, ["p"])
    merge.write_partitions(spark.createDataFrame([(1, "d")], "p long, x string"), at, ["p"])
    assert sorted((r["p"], r["x"]) for r in spark.read.parquet(at).collect()) == [(1, "d"), (2, "c")]


def plain_blocks(found, rows, most=8, shown=10, related=15):
    info = {r["row"]: r for r in rows}
    out = []
    for q in sorted({f["query"] for f in found}):
        mine = sorted((f for f in found if f["query"] == q), key=lambda f: f["place"])
        merged = {}
        for drawing in sorted({f["drawing"] for f in mine}, key=lambda d: min(f["place"] for f in mine if f["drawing"] == d)):
            own = [f for f in mine if f["drawing"] == drawing]
            sign = (info[own[0]["row"]]["context"], tuple(sorted((f["code"], f["position"], info[f["row"]]["quantity"]) for f in own)))
            got = merged.setdefault(sign, {"drawing": drawing, "validities": set(), "score": -1.0, "table": -1, "n": 0, "name": ""})
            got["validities"].add(info[own[0]["row"]]["validity"])
            got["score"], got["table"] = max([got["score"], *(f["score"] for f in own)]), max([got["table"], *(f["table_score"] for f in own)])
            got["n"], got["name"] = max(got["n"], len(own)), max(got["name"], info[own[0]["row"]]["table_name"])
        ranked = sorted(merged.values(), key=lambda b: b["drawing"])
        for key in ("name", "n", "table", "score"):  # stable sorts: the first key sorted last; all descending
            ranked.sort(key=lambda b: b[key], reverse=True)
        for i, b in enumerate(ranked[:most], 1):
            articles = [f for f in mine if f["drawing"] == b["drawing"]][:shown]
            codes, places = {f["code"] for f in articles}, [int(f["position"]) for f in articles]
            others = [r for r in rows if r["drawing"] == b["drawing"] and r["code"] not in codes]
            others.sort(key=lambda r: (min(abs(int(r["position"]) - p) for p in places), r["position"], r["code"], r["row"]))
            said = ", ".join(sorted(b["validities"]))
            out += [(q, i, "found", k, f["drawing"], f["code"], f["position"], said) for k, f in enumerate(articles, 1)]
            out += [(q, i, "related", k, r["drawing"], r["code"], r["position"], said) for k, r in enumerate(others[:related], 1)]
    return sorted(out)


def test_blocks_equal_a_plain_version(spark):
    """Drawings with the same rows are one block; blocks by score, table score, number of rows and name, all descending."""
    rng = random.Random(2)
    rows = [{"row": d * 100 + i, "drawing": d, "code": f"c{rng.randrange(4) if d % 3 else i}", "position": str(1 + i), "quantity": 1.0, "context": f"ctx {d % 2}", "table_name": f"t{d % 2}", "validity": f"v{d % 5}"} for d in range(24) for i in range(2 + d % 3 * 9)]
    found = []
    for q in ("a", "b"):
        hits = sorted(({"query": q, "row": r["row"], "drawing": r["drawing"], "code": r["code"], "position": r["position"], "score": float(rng.randrange(3)), "table_score": rng.randrange(2)} for r in rows if rng.random() < 0.6), key=lambda h: (-h["score"], -h["table_score"], h["drawing"], h["position"], h["code"]))
        found += [h | {"place": i} for i, h in enumerate(hits, 1)]
    schema = "row long, drawing long, code string, position string, quantity double, context string, table_name string, validity string"
    hits = spark.createDataFrame([tuple(f.values()) for f in found], "query string, row long, drawing long, code string, position string, score double, table_score int, place int")
    got = search.blocks(hits, spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    columns = ["query", "block", "kind", "rank", "drawing", "code", "position", "validities"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == plain_blocks(found, rows)


def test_catalog_index(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<table>" + row("<a href='x.pdf'>p</a><a href='cat/star%20qu/INDEX.HTM'>o</a>", "Star", "PBT1", "A......", "-", "Mod. 3450, 3460,", "3450. Mod. John Deere: 1847F, words") + row("<a href='/cat/star%20qu/index.html'>again</a>", *"abcd") + row("<a href='/cat/few/index.htm'>few</a>", "x", "y", "z") + row(*"abcde") + row("<a href='/cat/two/index.htm'>t</a>", "S", "P", "A1", "B2") + "</table>"
    pages = spark.createDataFrame([(1, "http://h/p/list.html", html)], "page_id long, url string, html string")
    found = C.catalog_index(N.page_nodes(pages), pages).orderBy("code").collect()
    assert [(r.code, r.url, r.series, r.publication, r.valid_from, r.valid_to, r.models) for r in found] == [
        ("star qu", "http://h/p/cat/star%20qu/INDEX.HTM", "Star", "PBT1", "", "", ["3450", "3460", "1847F"]),
        ("two", "http://h/cat/two/index.htm", "S", "P", "A1", "B2", []),
    ]
    assert found[0].description.startswith("p o Star PBT1 A...... - Mod. 3450")


def test_page_titles(spark):
    table = spark.createDataFrame([(1, "www.x.it page\nHD Series\n 12 34 567\nGear\nGear box front \n x"), (2, None), (3, "short")], "page long, text string")
    assert [tuple(r) for r in D.page_titles(table).collect()] == [(1, "Gear box front")]
    assert [r[0] for r in spark.createDataFrame([("1234567",), ("20001 200 001A",), ("x",), (None,)], "c string").select(D.is_code(F.col("c"))).collect()] == [True, True, False, False]


def test_machines_by_frame_number_name_and_serial(spark):
    models = [(1, "Argon 65", "VINVINVINVIN001", "AB50001 / 60001"), (2, "Argon 65", "VINVINVINVIN002", "AB55001"), (3, "Argon 65", "VINVINVINVIN003", "XYZ00001"), (4, "Krypton", "VINVINVINVIN004", None), (5, "Krypton 5DT", None, "CD1")]
    asked = [
        ("vin", "vinvinvinvin-004", None, False), ("vin2", "argon 65", "VINVINVINVIN002", False), ("name", "argon 65", None, True), ("found", "ARGON 65", "AB 57000", True), ("unsure", "argon 65", "ab61000", None),
        ("early", "argon 65", "AB00005", True), ("apart", "argon 65", "Q99999", True), ("bare", "argon 65", "99", True), ("unread", "argon 65", "x?", True), ("one", "krypton", None, True), ("spaced", "krypton 5 dt", None, True), ("like", "kripton", None, True), ("none", "zzzzzzz", None, True),
    ]
    found = resolve.resolve_machines(spark.createDataFrame(asked, "request string, text string, serial string, sure boolean"), spark.createDataFrame(models, "model long, name string, vin string, starts string"))
    got = {}
    for r in found.orderBy("request", "model").collect():
        got.setdefault((r.request, r.stage, r.policy, r.remark), []).append(r.model)
    assert got == {
        ("vin", 1, "selected", None): [4], ("vin2", 1, "selected", None): [2], ("name", 2, "confirm", None): [1, 2, 3], ("found", 2, "selected", "found"): [2], ("unsure", 2, "confirm", "found"): [1],
        ("early", 2, "confirm", "too_early"): [1, 2, 3], ("apart", 2, "confirm", "none_compatible"): [1, 2, 3], ("bare", 2, "selected", "found"): [3], ("unread", 2, "confirm", "unreadable"): [1, 2, 3],
        ("one", 2, "selected", None): [4], ("spaced", 3, "selected", None): [5], ("like", 4, "confirm", None): [4, 5],
    }
