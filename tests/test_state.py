"""Conversation state, work queues, published tables, the log writer, and ranked answers against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, logs, publish
from quarry.streaming import conversations as C
from quarry.streaming import journal

CALLS = "conv long, seq long, kind string, brand string, declared boolean, another boolean, serial string, model string, selected string, uncertain boolean"


def call(conv, seq, kind, brand=None, declared=False, another=False, serial=None, model=None, selected=None, uncertain=False):
    return (conv, seq, kind, brand, declared, another, serial, model, selected, uncertain)


TALK = [
    call(1, 1, "user"), call(1, 2, "find", "sdf", True, selected="Agro 75", serial="ab-1"), call(1, 3, "search", serial="AB 1", model="agro"), call(1, 4, "search", serial="AB2"), call(1, 5, "search", serial="AB2"),
    call(1, 6, "find", "sdf", uncertain=True), call(1, 7, "choose", selected="Agro 90"), call(1, 8, "search"), call(1, 9, "user"), call(1, 10, "choose", selected="Agro 90"), call(1, 11, "search", model="agro 75"),
    call(1, 12, "find", "other", another=True, uncertain=True), call(1, 13, "find", None, True, selected="X", serial=None),
]
STATES = [
    (None, None, None, False, False, False), ("sdf", "AB1", "Agro 75", False, False, True), ("sdf", "AB1", "Agro 75", False, False, False), ("sdf", None, None, False, True, False), ("sdf", None, None, False, False, False),
    ("sdf", None, None, True, False, True), ("sdf", None, None, True, True, False), ("sdf", None, None, True, True, False), ("sdf", None, None, False, False, False), ("sdf", None, "Agro 90", False, False, False), ("sdf", None, None, False, True, False),
    (None, None, None, True, False, False), (None, None, "X", False, False, False),
]


def test_conversation_state(spark):
    rows = C.call_states(spark.createDataFrame([*TALK, call(None, 1, "find"), call(2, 1, "search", model="y")], CALLS)).orderBy("conv", "seq").collect()
    assert [tuple(r)[2:] for r in rows if r.conv == 1] == STATES
    assert [tuple(r) for r in rows if r.conv != 1] == [(2, 1, None, None, None, False, False, False)]


def test_conversation_state_streams(spark, tmp_path):
    """The stream keeps its state between batches, and gives what the batch form gives."""
    rng = random.Random(1)
    calls = [call(c, i, rng.choice(["user", "find", "choose", "search"]), rng.choice([None, "a", "b"]), rng.random() < 0.5, rng.random() < 0.2, rng.choice([None, "s1", "s2"]), rng.choice([None, "m 1", "m 2"]), rng.choice([None, "m 1", "n 2"]), rng.random() < 0.2) for c in range(9) for i in range(20)]
    for part in range(4):
        spark.createDataFrame([x for x in calls if x[1] // 5 == part], CALLS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = C.call_state_stream(files).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["conv"], r["seq"])
    streamed = sorted(spark.read.schema(C.OUT).parquet(f"{tmp_path}/out").collect(), key=key)
    assert streamed == sorted(C.call_states(spark.createDataFrame(calls, CALLS)).collect(), key=key)


@pytest.mark.parametrize("seed", [0, 1])
def test_queue_order_equals_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    items = [(q, 100 * q + i, i * 7 % 13) for q in range(4) for i in range(13)]
    outcomes = [(item, a, rng.random() < 0.4) for _, item, _ in items for a in range(1, 6) if rng.random() < 0.9]
    ok = {(i, a): o for i, a, o in outcomes}
    want = []
    for q in range(4):
        work, position = deque((item, 1) for _, item, _ in sorted((x for x in items if x[0] == q), key=lambda x: x[2])), 0
        while work:
            item, attempt = work.popleft()
            good = ok.get((item, attempt), False)
            want.append((q, item, attempt, position, good))
            position += 1
            if not good and attempt < 3:
                work.append((item, attempt + 1))
    found = logs.queue_order(spark.createDataFrame(items, "queue long, item long, at long"), spark.createDataFrame(outcomes, "item long, attempt int, ok boolean"))
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(want)
    assert {r["item"] for r in found.collect() if r["state"] == "failed"} == {i for _, i, a, _, g in want if a == 3 and not g}


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    one, two = spark.range(3), spark.range(5).withColumn("x", F.lit("a"))
    assert publish.manifest(spark, root) == {"version": None, "tables": {}}
    assert publish.publish(spark, root, {"one": one, "two": two}) == {"one": 3, "two": 5}
    before = publish.manifest(spark, root)
    with pytest.raises(Exception, match="broken"):
        publish.publish(spark, root, {"one": spark.range(9), "two": two.withColumn("x", F.raise_error(F.lit("broken")))})
    assert publish.manifest(spark, root) == before
    assert [t.count() for t in publish.published(spark, root, "one", "two")] == [3, 5]
    assert publish.publish(spark, root, {"one": spark.range(7)}) == {"one": 7}
    assert [t.count() for t in publish.published(spark, root, "one", "two")] == [7, 5]
    assert publish.rebuild(spark, root, {"n": spark.range(4)}, {"double": lambda s: s["n"].selectExpr("id * 2 as id")}) == {"double": 4}


def test_set_where_counts_what_it_changes(spark, tmp_path):
    out, changed = publish.set_where(spark.createDataFrame([(1, "P"), (2, None), (3, "F")], "id long, status string"), F.col("status") == "P", "status", F.lit(None).cast("string"))
    out.write.parquet(f"{tmp_path}/out")
    assert changed.get["changed"] == 1 and sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, None), (2, None), (3, "F")]


LOG = "session string, role string, text string, arguments string, outcome string"
MESSAGES = [("s", "tool", None, '{"a": 1}', "[]"), ("s", "tool", None, "{broken", None), ("s", "tool", None, '{"a": 1}{', None), ("s", "tool", None, "1,2", None), (None, "bot", "x", None, None), ("t", "nobody", "x", None, None), ("t", "customer", "é", None, None)]


def test_journal_sets_bad_rows_aside_and_survives_a_replay(spark, tmp_path):
    target = f"{tmp_path}/journal"
    rows = spark.createDataFrame(MESSAGES, LOG)
    for _ in range(2):  # the second time is a replay
        journal.write_batch(rows, 4, target, ["arguments", "outcome"])
    assert sorted((r.session, r.role, r.batch) for r in journal.logged(spark, target, LOG).collect()) == [("s", "tool", 4), ("t", "customer", 4)]
    assert sorted(r.problem for r in journal.set_aside(spark, target, LOG).collect()) == ["arguments is no JSON"] * 3 + ["no session", "unknown role"]


def test_a_log_that_cant_be_written_does_not_stop_the_stream(spark, tmp_path):
    (tmp_path / "log").write_text("a file where the folder should be")
    journal.write_batch(spark.createDataFrame(MESSAGES, LOG), 1, str(tmp_path), ["arguments", "outcome"])
    assert journal.set_aside(spark, str(tmp_path), LOG).count() == 7


def test_journal_streams(spark, tmp_path):
    spark.createDataFrame(MESSAGES, LOG).repartition(3).write.parquet(f"{tmp_path}/in")
    files = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    journal.journal(files, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert journal.logged(spark, f"{tmp_path}/out", LOG).count() == 2 and journal.set_aside(spark, f"{tmp_path}/out", LOG).count() == 5


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 1.0])
def test_top_under_filter_equals_filtering_first(spark, share):
    rng = random.Random(3)
    scored = [(q, r, round(rng.random(), 1)) for q in range(5) for r in range(40 * q)]
    facts = [(r, rng.random() < share) for r in range(200)]
    good = dict(facts)
    found = answers.top_under_filter(spark.createDataFrame(scored, "query long, row long, score double"), spark.createDataFrame(facts, "row long, fine boolean"), "row", F.col("fine"), 6, first=2)
    want = []
    for q in range(5):
        mine = sorted((-s, r) for p, r, s in scored if p == q and good[r])[:6]
        want += [(q, i, r, -s) for i, (s, r) in enumerate(mine, 1)]
    assert sorted((r["query"], r["place"], r["row"], r["score"]) for r in found.collect()) == want


def test_grouped_answer(spark):
    hits = [(1, i, "c", f"d{n}", "20", f"{n}_A", t, f, u, str(i), code, f"part {i}") for i, (n, t, f, u, code) in enumerate([(10, "Gear / b", "A1", "", "x"), (9, "Gear", None, None, "y"), (10, "Gear / b", "A1", "", "y"), (2, "Axle", None, "B2", "z")], 1)]
    table = spark.createDataFrame(hits, "query long, place int, catalog string, drawing string, grp string, number string, title string, valid_from string, valid_to string, position string, code string, description string")
    rows = answers.grouped_answer(table, tables=2, rows=1).orderBy("block", "rank").collect()
    assert [(r.block, r.context, r.remark, r.position) for r in rows] == [(1, "GROUP 20 DRAWING 2_A - Axle", "valid ... -> B2", "4"), (2, "GROUP 20 DRAWING 9_A - Gear", "", "2")]
    assert {(r.total_codes, r.ambiguous, tuple(tuple(v) for v in r.variants)) for r in rows} == {(3, True, (("Gear", 2),))}
