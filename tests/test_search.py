"""Ranked search and merges against plain versions written from their definitions."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.operators import merge as M
from quarry.operators import search as X
from quarry.streaming import ingest as I

CONCEPTS = [("seal", "anello tenuta", "guarnizione piatta;paraolio", "olio"), ("fan", "ventola", "elica del radiatore", "aria")]
RULES = [(1, "paraolio|anello", "seal"), (2, "ventol", "fan")]
CONTEXTS = [(1, "FRENI", "pedale")]


def vocabulary(spark):
    return X.Vocabulary(spark.createDataFrame(CONCEPTS, "concept string, name string, synonyms string, evokes string"), spark.createDataFrame(RULES, "priority int, pattern string, concept string"), spark.createDataFrame(CONTEXTS, "priority int, pattern string, words string"), ("seal",))


def catalog(spark):
    r = random.Random(4)
    names = ["anello tenuta 25 x 32 x 7", "paraolio", "ventola radiatore", "disco freno", "vite M8", "pedale freni", "tubo olio 25", None]
    rows = [(i, f"2.01{i:03d}.5", r.choice(names), r.choice(["1", "2.1", "10", None]), 1.0, i % 9, r.choice(["FRENI", "MOTORE"]), None, r.choice(["FRENI POSTERIORI", "ARIA"]), f"v{i % 3}") for i in range(80)]
    return spark.createDataFrame(rows, "row long, code string, description string, position string, quantity double, drawing long, grp string, subgroup string, table_name string, validity string")


def match(a, b):
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= 4 and len(long) - len(short) <= 2 and long.startswith(short))


def plain_search(rows, asked, concepts):
    found = lambda w, ts: any(match(w, t) for t in ts)
    out = []
    for p in rows:
        score, name, concept, table, ctx = 0.0, 0, 0, 0, 0
        if any(k in p["code"].lower() for k in asked["codes"]):
            score += 100
        for w in asked["words"]:
            if found(w, p["name_words"]):
                name += 1
            elif found(w, p["concept_words"]):
                concept += 1
            elif found(w, p["table_words"]):
                table += 1
            elif found(w, p["context_words"]):
                ctx += 1
        score += 2 * (name + concept) + (0.5 if p["concept"] == "seal" else 1.0) * (table + ctx)
        if name + concept:
            if asked["head"] and (found(asked["head"], p["name_words"]) or found(asked["head"], p["concept_words"])):
                score += 0.5
            score -= min(0.4, 0.1 * sum(not any(match(w, d) for w in asked["words"]) for d in p["name_words"]))
        it = iter(p["numbers"])
        if asked["measures"] and all(x in it for x in asked["measures"]):
            score += 4
        if score > 0:
            out.append((-score, -table, p["drawing"], p["position"] or "", p["code"], p["row"], concepts[p["concept"]] if concept and p["concept"] else None))
    return sorted(out, key=lambda x: x[:6])[:60]


def test_ranked_search_matches_the_definition(spark):
    words = vocabulary(spark)
    prepared = X.prepare(catalog(spark), words).cache()
    queries = spark.createDataFrame([("a", "guarnizioni freni"), ("b", "ventole del radiatore"), ("c", "25 x 32 x 7"), ("d", "2.01004.5"), ("e", "xyzzy"), ("f", ""), ("g", "pedale olio aria"), ("h", None)], "query string, text string")
    found = defaultdict(list)
    for r in X.search(prepared, queries, words).orderBy("query", "place").collect():
        found[r["query"]].append((r["row"], round(r["score"], 6), r["table_score"], r["found_as"]))
    rows, names = [r.asDict() for r in prepared.collect()], {c: n for c, n, _, _ in CONCEPTS}
    for asked in X.parse(queries).collect():
        want = [(x[5], round(-x[0], 6), -x[1], x[6]) for x in plain_search(rows, asked, names)]
        assert found[asked["query"]] == want
    blocks = X.blocks(X.search(prepared, queries, words), prepared).cache()
    assert blocks.where("kind = 'found' and rank > 10 or rank > 15 or block > 8").count() == 0


def test_upserts_are_idempotent_and_keep_columns(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, None)], "k long, seq long, v string")
    once = M.last_wins(rows, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, M.last_wins(once.union(rows), ["k"], "seq").collect())) == [(1, 2, "b"), (2, 5, None)]
    assert sorted(map(tuple, M.first_wins(rows, ["k"], "seq").collect())) == [(1, 1, "a"), (2, 5, None)]
    old = spark.createDataFrame([(1, "x", None), (2, "", "s")], "k long, a string, b string")
    new = spark.createDataFrame([(1, "", "t"), (3, "z", None)], "k long, a string, b string")
    merged = {r["k"]: (r["a"], r["b"]) for r in M.merge(old, new, ["k"], {"a": "prefer_new_text", "b": "prefer_old"}).collect()}
    assert merged == {1: ("x", "t"), 2: ("", "s"), 3: ("z", None)}


def test_stream_upsert_replays_to_the_same_table(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    for run in range(2):
        I.ingest(I.file_stream(spark, str(tmp_path / "in"), rows.schema, 2), ["k"], "seq", str(tmp_path / "out"), str(tmp_path / f"state{run}"), 4).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).select("k", "seq").collect()
        assert sorted(map(tuple, got)) == [(k, 450 + k) for k in range(50)]


def test_more_queries_than_one_block_give_the_same_neighbours(spark, monkeypatch):
    from quarry.operators import vector

    rows = [(i, [float((i * k) % 7) + 0.1 * k for k in range(1, 6)]) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = d.selectExpr("id as query", "v as vector")
    want = sorted(map(tuple, vector.top_k(d, asked, "id", "v", 4).collect()))
    monkeypatch.setattr(vector, "QUERY_MB", 0.0002)
    assert len(want) == 240 and sorted(map(tuple, vector.top_k(d, asked, "id", "v", 4).collect())) == want
    assert vector.top_k(d, asked.limit(0), "id", "v", 4).count() == 0


def test_near_pairs_are_all_within_the_distance(spark):
    import random

    from quarry.operators import joins as J

    r = random.Random(3)
    texts = ["", "A", "AB", "ABC", *["".join(r.choices("AB", k=n)) for n in (2, 3, 5, 6, 6, 7, 8, 8) for _ in range(12)]]
    left, right = spark.createDataFrame([(x,) for x in texts[::2]] + [(None,)], "a string"), spark.createDataFrame([(x,) for x in texts[1::2]] + [(None,)], "b string")
    for most in (1, 3):
        found = sorted(map(tuple, J.near_pairs(left, "a", right, "b", most).collect()))
        assert found == sorted({(a, b) for a in texts[::2] for b in texts[1::2] if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= most})


def test_serials_resolve_as_by_hand(spark):
    import random

    from quarry.operators import joins as J

    r = random.Random(5)
    code = lambda k: "".join(r.choices("ABC", k=k))
    variants = [(v, code(r.choice((2, 5))) + f"{r.randrange(10000, 10060):05d}") for v in range(60)] + [(3, "ABCAB10010"), (4, "ABCAB10010"), (3, "ABCAB10010")]
    requests = [(i, r.choice(("", code(2), code(5), code(5), "ABCDEFG")) + f"{r.randrange(9990, 10070):05d}") for i in range(200)] + [(900, "??"), (901, None), (902, "ABCAB10011"), (902, "ABCAB10011")]
    asked, known = spark.createDataFrame(requests, "request long, serial string"), spark.createDataFrame(variants, "variant long, starts string")
    found = sorted(map(repr, map(tuple, J.resolve_serials(asked, known).collect())))
    want = []
    for request, serial in requests:
        if not serial or not serial[-1].isdigit():
            want.append((request, "unreadable", None, None, 0))
            continue
        q, n = serial[:-5], int(serial[-5:])
        fits = [(int(s[-5:]), v) for v, s in variants if not q or (len(q) == len(s) - 5 and sum(x != y for x, y in zip(q, s)) <= 3)]
        best = max((s for s, _ in fits if s <= n), default=None)
        at = {v for s, v in fits if s == best}
        outcome = "none_compatible" if not fits else "too_early" if best is None else "ambiguous" if len(at) > 1 else "found"
        want.append((request, outcome, min(at) if len(at) == 1 else None, best, len(at) if best is not None else 0))
    assert found == sorted(map(repr, want))
