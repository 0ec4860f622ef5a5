"""Corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

1. language   documents that the identifier rejects go; a null lang is filled in
2. near-dups  of each component of the Jaccard join (5-word shingles, 0.8 or more) the document with the smallest id stays
3. secrets    reported spans are masked in the text; no document goes
4. mixing     documents are sampled to source, language and topic targets
5. tokens     documents are encoded to token ids and decoded again

The first four return the columns of documents, whatever other columns there are and however they are named. Documents with a null id
cannot be told apart, so none of them goes in stage 2; of repeated rows of one id and text one stays there. Rows of one id with
different texts are judged each by its own text. SQL cannot express the models of stages 1 and 5, so there is no ORACLE_SQL; tests
compare each stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, langid, mixing, secrets
from quarry.llm.common import any_names, free_names, settle, table

#: Near-duplicates link from this similarity on, in words of so many a shingle.
PERCENT, WORDS = 80, 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _first_of_each(docs)


@any_names
def _first_of_each(docs: DataFrame) -> DataFrame:
    mark, gone_id, gone_mark = free_names(docs.columns, "mark", "gone_id", "gone_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    judged = marked.select("doc_id", "text", F.col(mark).alias("text_hash"))
    found = jaccard.similar_components(judged, PERCENT, WORDS, mark="text_hash").where("doc_id is not null").select("doc_id", "text_hash", "first")
    found = settle(found.groupBy("doc_id", "text_hash").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("rows")))
    keys = [F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_mark)]
    same = (F.col("doc_id") == F.col(gone_id)) & (F.col(mark) == F.col(gone_mark))
    left = marked.join(found.where("not first").select(*keys), same, "left_anti")
    repeated = found.where("first and rows > 1").select(*keys)
    if not repeated.isEmpty():  # one row of each; the least by a hash of all columns, so that a rerun keeps the same
        each = left.join(repeated, same, "left_semi").groupBy("doc_id", mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
        left = left.join(repeated, same, "left_anti").select(*docs.columns).union(each.select("row.*"))
    return left.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [("language", language), ("near-duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
