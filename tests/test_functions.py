"""Text and serial functions on their defining examples, nulls, empty and accented texts."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import serials as S
from quarry.functions import text as T
from quarry.operators import joins as J


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


CASES = [
    (lambda: T.stem(F.lit("freni")), "fren"), (lambda: T.stem(F.lit("dischi")), "disc"), (lambda: T.stem(F.lit("kit")), "kit"), (lambda: T.stem(F.lit("àche")), "ach"), (lambda: T.stem(F.lit(None).cast("string")), ""),
    (lambda: T.keywords(F.lit("mi serve il filtro dell'olio")), ["filtr", "oli"]), (lambda: T.keywords(F.lit("2.0112.635.2 però")), ["2.0112.635.2", "per"]), (lambda: T.keywords(F.lit(""))  , []),
    (lambda: T.normalize(F.lit("P.T.O. e s.a.c.")), " pto  e  sac "), (lambda: T.words(F.lit("i dischi della frizione")), ["disc", "frizion"]), (lambda: T.words(F.lit(None).cast("string")), []),
    (lambda: T.numbers(F.lit("25 x 32,5 x 7")), ["25", "32.5", "7"]), (lambda: T.is_subsequence(F.array(F.lit("1"), F.lit("3")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))), True),
    (lambda: T.is_subsequence(F.array(F.lit("3"), F.lit("1")), F.array(F.lit("1"), F.lit("2"), F.lit("3"))), False),
    (lambda: T.looks_like_code(F.lit("2.0112.635")), True), (lambda: T.looks_like_code(F.lit("12345")), False), (lambda: T.looks_like_code(F.lit("1abcde")), False),
    (lambda: T.part_type(F.lit("anello tenuta speciale 25 x 32 x 7")), "anello tenuta speciale"), (lambda: T.part_type(F.lit("semiasse - DX/RH/RE")), "semiasse"), (lambda: T.part_type(F.lit("leva x frizione")), "leva frizione"),
    (lambda: T.unrepeated(F.lit("Frame KH 290 Frame KH 290")), "Frame KH 290"), (lambda: T.unrepeated(F.lit("")), ""), (lambda: T.head_word(F.lit("tubo del radiatore")), "tub"), (lambda: T.head_word(F.lit("di 25")), None),
    (lambda: T.context(F.lit("A"), F.lit(""), F.lit(None), F.lit("B")), "A / B"), (lambda: T.base_name(F.lit("guarnizione 215.6x222.4x3.4")), "guarnizione"), (lambda: T.base_name(F.lit("semibronzina banco + mm 0.25")), "semibronzina banco"),
    (lambda: T.base_name(F.lit("semibronzina banco STANDARD")), "semibronzina banco"), (lambda: T.expand_models(F.lit("MB 205, 280 , 350")), ["MB 205", "MB 280", "MB 350"]), (lambda: T.expand_models(F.lit("MB 205, tutti")), None),
    (lambda: T.models_in_text(F.lit("per HD-125 45 55"), "HD"), ["125", "145", "155"]), (lambda: T.models_in_text(F.lit("KH 180 & 185"), "KH"), ["180", "185"]), (lambda: T.spaced(F.lit("5105DF")), "5105 DF"),
    (lambda: T.after_arrow(F.lit("ARGON 65 -> NNZJY002W0BS00001")), "NNZJY002W0BS00001"), (lambda: T.position_number(F.lit("11.2")), 11), (lambda: T.position_number(F.lit("x")), None), (lambda: T.italian_number(F.lit("1.234,5")), 1234.5), (lambda: T.italian_number(F.lit("")), None),
    (lambda: S.letter_key(F.lit("C556210"))["n"], 556210), (lambda: S.letter_key(F.lit("556210")), None), (lambda: S.tail_key(F.lit("00906")), 906), (lambda: S.tail_key(F.lit("08-00216")), 216), (lambda: S.tail_key(F.lit("x")), None),
    (lambda: S.split_serial(F.lit("NNZJY002W0BS00001"))["prefix"], "NNZJY002W0BS"), (lambda: S.split_serial(F.lit("ab-12"))["n"], 12), (lambda: S.split_serial(F.lit(""))["n"], None),
    (lambda: F.transform(S.catalog_starts(F.lit("56450WVT50001 / 60001")), lambda x: F.concat_ws(":", x["prefix"], x["n"].cast("string"))), ["56450WVT:50001", "56450WVT:60001"]), (lambda: F.size(S.catalog_starts(F.lit("60001"))), 0),
    (lambda: S.within(F.lit(None).cast("long"), F.lit(5), F.lit(6)), True), (lambda: S.within(F.lit(4), F.lit(5), F.lit(None).cast("int")), False), (lambda: S.compatible(F.lit("abcd"), F.lit("abxx")), True), (lambda: S.compatible(F.lit("abc"), F.lit("abcd")), False),
    (lambda: T.token_match(F.lit("ventol"), F.lit("ventole")), True), (lambda: T.token_match(F.lit("marc"), F.lit("marci")), True), (lambda: T.token_match(F.lit("ari"), F.lit("particolari")), False),
    (lambda: T.arrow_interval(F.lit("sn: 00001→00905"))["high"], "00905"), (lambda: T.arrow_interval(F.lit("15-15275->"))["high"], None), (lambda: T.arrow_interval(F.lit("no arrow")), None), (lambda: T.name_and_interval(F.lit("Tigre 2000 (-> 15-09599)"))["name"], "Tigre 2000"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_examples(spark, i):
    column, want = CASES[i]
    assert value(spark, column()) == want


def test_token_keys_join_equals_the_predicate(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 8))) for _ in range(150)})
    a, b = spark.createDataFrame([(w,) for w in words[::2]], "a string"), spark.createDataFrame([(w,) for w in words[1::2] + words[:20:2]], "b string")
    joined = {tuple(x) for x in J.match_tokens(a, b).collect()}
    assert joined == {tuple(x) for x in a.crossJoin(b).where(T.token_match(F.col("a"), F.col("b"))).collect()}


def test_as_of_ties_and_no_start(spark):
    starts = spark.createDataFrame([("k", 10, "a"), ("k", 20, "b"), ("k", 20, "c"), ("k", 10, "a")], "k string, start long, v string")
    probes = spark.createDataFrame([(1, "k", 9), (2, "k", 10), (3, "k", 25), (4, "z", 50), (5, None, 5)], "p long, k string, at long")
    found = {r["p"]: (r["start"], r["v"], r["n_at_start"]) for r in J.as_of(probes, starts, ["k"], "at", "start").collect()}
    assert found == {1: (None, None, None), 2: (10, "a", 1), 3: (20, "b", 2), 4: (None, None, None), 5: (None, None, None)}


def test_first_rule_takes_the_lowest_priority(spark):
    types = spark.createDataFrame([("small ring",), ("ring",), ("none",)], "t string")
    rules = spark.createDataFrame([(2, "ring", "ring"), (1, "small", "small")], "priority int, pattern string, concept string")
    assert dict(tuple(x) for x in J.first_rule(types, "t", rules).collect()) == {"small ring": "small", "ring": "ring", "none": None}


def test_another_machine_and_declared_brand(spark):
    from pyspark.sql import functions as F

    from quarry.functions import machines as M

    rows = [
        ("AB-12", None, "ab 12", "argon 65", False), ("AB13", None, "AB12", None, True), (None, "Argon 65 F", "X1", "argon 65", False),
        (None, "krypton 115", None, "Argon 65", True), (None, "argon 70", None, "argon 65", True), (None, "argon", None, "argon 65", False),
        (None, "Lux", None, "argon 65", False), (None, None, None, None, False), ("", "", "AB12", "argon", False),
    ]
    d = spark.createDataFrame(rows, "serial string, model string, was_serial string, was_model string, want boolean")
    got = d.select("want", M.machine_changed(F.col("serial"), F.col("model"), F.col("was_serial"), F.col("was_model"), ["lux"]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    rows = [
        ("una Lux", "x", "ho una LUX 55", True), (None, "Lux", "ho un lux!", True), (None, "Lux", "deluxe", False), (None, "lux", "la Casa-Nova rossa", True),
        (None, "x", "lux", False), ("", "lux", "", False), (None, None, None, False),
    ]
    d = spark.createDataFrame(rows, "quote string, brand string, message string, want boolean")
    got = d.select("want", F.coalesce(M.declared_brand(F.col("quote"), F.col("brand"), F.col("message"), [["lux", "casa nova"]]), F.lit(None)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
