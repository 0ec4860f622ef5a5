"""The pipeline's stages against plain versions, over the smallest table and one with awkward rows."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import bpe
from tests.llm.test_jaccard import brute
from tests.llm.test_operators import TEXTS, brute_base, docs_of

SMALL = "/root/testdata/sf0.001"


def run_stages(spark, docs):
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], None).cache())
    return out


def check(spark, docs):
    docs = docs.cache()
    start, language, near, secret, mixture, tokens = run_stages(spark, docs)
    for df in (language, near, secret, mixture):
        assert df.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in language.collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in language.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
    keep = {k for _, _, k in brute(rows, P.PERCENT, P.WORDS)}  # the task's own figures for near duplicates: five words, 0.8
    got = [r["doc_id"] for r in near.where("doc_id is not null").collect()]
    assert sorted(got) == sorted(keep)
    assert secret.count() == near.count()
    for r in secret.collect():
        old = texts[r["doc_id"]] if r["doc_id"] is not None else r["text"]
        assert (r["text"] == old) == (not brute_base(old)) and not brute_base(r["text"].replace("[SECRET]", " ") if r["text"] else r["text"])
    assert {r["doc_id"] for r in mixture.collect()} <= set(got) | {None}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    final = {r["doc_id"]: r["text"] for r in mixture.collect()}
    for r in tokens.collect():
        ids = library.encode(final[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stage_list():
    assert 4 <= len(P.STAGES) <= 5 and all(callable(f) for _, f in P.STAGES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_stages_match_plain_versions(spark):
    check(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_stages_with_awkward_rows(spark):
    rows = [*TEXTS, *((100 + i, "password=abcdef1 " + " ".join(random.Random(i).choice(["uno", "due", "tre", "quattro"]) for _ in range(30))) for i in range(40))]
    check(spark, docs_of(spark, rows, repeat=True).select("doc_id", "text", "lang", "source", F.col("n_chars")))


def test_empty_table(spark):
    docs = docs_of(spark).limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    assert run_stages(spark, docs)[-1].count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, words(1)), (2, words(1) + " end"), (2, words(2)), (2, words(2)), (3, words(3)), (3, words(3) + " end"), (None, words(1))]
    docs = docs_of(spark, rows, repeat=False).select("doc_id", "text")
    got = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, None).collect()]
    assert sorted(x for x in got if x[0] in (1, 2)) == [(1, words(1)), (2, words(2))]
    assert len([x for x in got if x[0] == 3]) == 1 and (None, words(1)) in got and len(got) == 4


CLASHING = ("kept", "probability", "topic", "n_tokens", "mix_p", "mix_lang", "_n", "_gone", "_mark", "mark", "gone_id", "_d", "_k", "_spans", "own_id", "text_hash", "all_spans", "_h", "sid", "comp", "first", "rejected", "meta.url", "a`b", "text.x")


def test_columns_of_any_name_come_through(spark):
    rows = [(i, " ".join(f"w{(i % 25) * 70 + k}" for k in range(60)) + (" password=abcdef1" if i % 5 == 0 else "")) for i in range(50)]
    docs = docs_of(spark, [*rows, rows[0]], repeat=False).select("doc_id", "text", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("a")}).cache()
    for out in run_stages(spark, docs)[1:-1]:
        assert out.dtypes == docs.dtypes and out.count()
        for r in out.collect():
            assert all(r.asDict()[c] == f"{c}{r['doc_id']}" for c in CLASHING)


def test_language_and_mixture_match_plain_versions(spark):
    from quarry.llm import langid, mixing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    judged = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    got = {r["doc_id"]: r["lang"] for r in P.language(spark, docs, None).collect()}
    want = {r["doc_id"]: r["lang"] or judged[r["doc_id"]]["lang_pred"] for r in docs.collect() if not judged[r["doc_id"]]["rejected"]}
    assert got == want

    mixed = {r["doc_id"]: r for r in mixing.mix_sources(docs, within=True).collect()}
    draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:12], 16) / 2**48
    want = {i for i, r in mixed.items() if draw(i) < r["probability"]}
    assert {r["doc_id"] for r in P.mixture(spark, docs, None).collect()} == want
