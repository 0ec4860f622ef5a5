"""Approximate matching of words against small pools: Ratcliff-Obershelp similarity in Arrow batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from quarry.functions import text as T

POOL = 100_000


def _plain(s: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """the ratio of matching characters, which depends on the order of its arguments: the query first."""
    return pd.Series([SequenceMatcher(None, _plain(x), _plain(y)).ratio() for x, y in zip(a, b, strict=True)])


def most_similar(queries: DataFrame, pool: DataFrame, least: float = 0.72, most: int = 5) -> DataFrame:
    """query, candidate, score, place. The pool (candidate) is a vocabulary of bounded size, checked; each distinct query meets it once."""
    distinct = pool.select("candidate").distinct()
    if distinct.limit(POOL + 1).count() > POOL:
        raise ValueError("the pool is no small vocabulary")
    scored = queries.select("query").distinct().join(F.broadcast(distinct), F.lit(True)).withColumn("score", similarity("query", "candidate")).where(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def correct_terms(queries: DataFrame, synonyms: DataFrame, least: float = 0.85) -> DataFrame:
    """query, corrected: the precise term of an improper one (synonyms: improper, precise), by equality without accents and case, else by similarity, else the query."""
    plain = lambda c: F.trim(F.lower(T.fold(F.col(c))))
    exact = synonyms.groupBy(plain("improper").alias("k")).agg(F.min("precise").alias("exact"))
    direct = queries.select("query").distinct().withColumn("k", plain("query")).join(exact, "k", "left")
    near = most_similar(direct.where("exact is null").select("query"), synonyms.select(F.col("improper").alias("candidate")), least, 1)
    told = near.join(synonyms.groupBy(F.col("improper").alias("candidate")).agg(F.min("precise").alias("near")), "candidate").select("query", "near")
    return direct.join(told, "query", "left").select("query", F.coalesce("exact", "near", "query").alias("corrected"))
