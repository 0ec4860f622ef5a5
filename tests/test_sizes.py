"""Queries over keys and tables as larger copies have them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators import answers
from quarry.operators import joins as J
from quarry.sources import documents


@pytest.fixture
def tables(tmp_path):
    """Writes tables from SQL, and compares a query over them with its SQL."""

    def equal(spark, name, **sql):
        con = duckdb.connect()
        for table, said in sql.items():
            at = os.path.join(tmp_path, f"{table}.parquet")
            con.execute(f"COPY ({said}) TO '{at}'")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{at}'")
        df = registry.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        found = [tuple(r[c] for c in columns) for r in df.collect()]
        assert sorted(found, key=repr) == sorted(map(tuple, want), key=repr)
        return found

    return equal


def test_customers_without_orders_or_known_status(spark, tables):
    tables(spark, "a13_completeness", customer="SELECT range AS c_custkey FROM range(4)", orders="SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'F'), (2, 1, 'O'), (3, 2, NULL)) t(o_orderkey, o_custkey, o_orderstatus)")


PARTS = "SELECT unnest([7, 89999, 90000, 123456, 1234567, 98765432])::BIGINT AS p_partkey, 9 AS p_size"


@pytest.mark.parametrize("name", ["f9_tail_serial", "f11_catalog_starts"])
def test_serials_of_large_keys(spark, tables, name):
    tables(spark, name, part=PARTS)


def test_near_texts_of_all_lengths(spark):
    """near_pairs against every pair, for lengths below and above its segments; and few pairs meet that are too far apart."""
    import random

    deal = random.Random(5)
    word = lambda: "".join(deal.choice("ab\x00") for _ in range(deal.randint(0, 11)))
    a, b = [word() for _ in range(150)] + [None], [word() for _ in range(150)] + [None]
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    for most in (1, 3):
        found = [tuple(r) for r in J.near_pairs(left, "a", right, "b", most).collect()]
        want = {(x, y) for x in a if x is not None for y in b if y is not None and len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) <= most}
        assert len(found) == len(set(found)) and set(found) == want
    hexes = lambda n: spark.range(1000).select(F.left(F.md5(F.concat(F.lit(n), F.col("id").cast("string"))), F.lit(6)).alias(n))
    # 20 choices of three places: 1000 x 1000 pairs meet about 20 / 4096 of the time, where one segment of one place let 1 / 16 meet, twice
    cuts = J.choices_of(hexes("a"), "a", "_sa", 3).join(J.choices_of(hexes("b"), "b", "_sb", 3), ["_len", "_of", "_k"])
    assert J.near_pairs(hexes("a"), "a", hexes("b"), "b", 3).count() <= cuts.count() < 10_000


def test_open_intervals_are_dealt_over_all_tasks(spark, tables, tmp_path):
    tables(spark, "p12_open_interval", part="SELECT range AS p_partkey, (range % 50)::INT AS p_size FROM range(200)", customer="SELECT range AS c_custkey FROM range(401)")
    assert registry.QUERIES["p12_open_interval"](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_machines_do_not_pass_through_the_driver(spark, tables, tmp_path):
    """Many requests for one name of many models: as in SQL by name and serial, and no table of models or requests is broadcast."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS p_partkey, 'Gear' AS p_name, 5 AS p_size FROM range(400)) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT range AS c_custkey FROM range(300)) TO '{tmp_path}/customer.parquet'")
    found = registry.QUERIES["x10_resolve_machines"](spark, str(tmp_path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    starts = {m: (f"PX{m % 5}", m * 131 % 100000) for m in range(400)}
    rows = {}
    for r in found.collect():
        rows.setdefault(r.request, []).append(r)
    for c in range(300):
        n = None if c % 13 == 0 else c * 37 % 100000
        low = [s for _, s in starts.values() if n is not None and s <= n]  # all prefixes are within three places
        hits = sorted(m for m in starts if low and starts[m][1] == max(low)) or sorted(starts)
        assert sorted(r.model for r in rows[c]) == hits[:12] and {r.candidates for r in rows[c]} == {len(hits)}


def test_codes_by_type_shuffle_rows_before_queries_meet_them(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    hits = df([(1, 7, 0.5), (1, 7, 0.5), (2, 7, 0.25), (3, 8, 0.1), (4, 7, 0.4)], "query long, type int, score double")
    asked = df([(1, None, "m1"), (1, None, "m2"), (2, "s1", None), (4, "s2", "M3")], "query long, series string, model string")
    parts = df([(10, "gear", 7), (11, "bolt", 8), (12, "pin", None)], "code long, description string, type int")
    rows = df([(1, 10, 5, 1), (2, 10, 6, 1), (3, 10, 6, 1), (4, 10, 6, 2), (5, 11, 5, 1), (6, 12, 5, 1), (7, 10, 6, 3)], "row long, code long, drawing long, position int")
    drawings = df([(5, "S1", "a"), (6, "S2", "b")], "drawing long, series string, title string")
    row_models = df([(1, "M2"), (2, "M1"), (3, "M3"), (4, "M9"), (7, None)], "row long, model string")
    found = answers.codes_by_type(hits, asked, parts, rows, drawings, row_models)
    got = sorted((r.query, r.series, r.position) for r in found.collect())
    assert got == [(1, "S1", 1), (1, "S2", 1), (2, "S1", 1), (4, "S2", 1)]
    assert found._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


LINES = "SELECT range % 50 AS l_orderkey, range % 37 AS l_partkey, range % 5 AS l_suppkey, (range % 7)::INT AS l_linenumber, CASE range % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' END AS l_returnflag FROM range(300)"


@pytest.mark.parametrize("name", ["u1_difference", "s14_fill_merged"])
def test_few_bytes_of_many_rows_are_dealt_over_all_tasks(spark, tables, tmp_path, name):
    tables(spark, name, lineitem=LINES)
    assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_codes_meet_two_neighbours_a_place(spark, tables, tmp_path):
    tables(spark, "j18_one_digit", part="SELECT range AS p_partkey FROM range(400)")
    assert "row_number" in plan_of(registry.QUERIES["j18_one_digit"](spark, str(tmp_path)))


def test_copies_of_one_value_meet_their_band_once(spark, tables):
    left = spark.range(400).select(F.col("id").alias("a"), F.lit("k").alias("k"), (F.col("id") % 2 * 10.0).alias("y"))
    right = spark.range(300).select(F.col("id").alias("b"), F.lit("k").alias("k"), (F.col("id") % 3 * 4.0 + 1).alias("hy"))
    found = J.band_nearest(left, right, ["k"], "y", "hy", 20.0, "b")
    assert {(r.a % 2, r.b) for r in found.collect()} == {(0, 0), (1, 2)} and found.count() == 400
    assert "Aggregate [k" in plan_of(found) and plan_of(found).count("Aggregate [k") >= 3
    tables(spark, "j10_band_nearest", part="SELECT range AS p_partkey, 'Brand#' || range % 30 AS p_brand, (range % 50)::INT AS p_size FROM range(600)", supplier="SELECT range AS s_suppkey, (range % 90 * 1.5)::DOUBLE AS s_acctbal FROM range(300)")


def test_words_are_gathered_once_for_positions_of_one_height(spark):
    anchors = spark.createDataFrame([(1, "a", 10.0), (1, "b", 10.0), (1, "c", 10.0), (1, "c", 60.0), (1, "d", 200.0), (1, "e", None)], "page long, position string, y double")
    words = spark.createDataFrame([(1, "w", 3.0, 12.0), (1, "v", 1.0, 5.0), (1, "u", 2.0, 65.0)], "page long, word string, wx double, wy double")
    found = documents.ocr_rows(anchors, words.select("*", F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"), F.lit(0.5).alias("confidence")))
    assert {r.position: r.description for r in found.collect()} == {"a": "v w", "b": "v w", "c": "v u w"}
    assert "_ys" in plan_of(found)
