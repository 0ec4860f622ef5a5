"""Audits: reconciliation of two versions, snapshots, coverage, retrieval metrics, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mode_per_group(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """A5: the most frequent value of each group; ties go to the value met first (smallest seq). Two aggregations, no window."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys on either side whose values differ, with both values."""
    a, b = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_a")), new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_b"))
    return a.join(b, keys, "full").where("not (old <=> new) or _a is null or _b is null").drop("_a", "_b")


def reconcile(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """Per group what both sides, only the left and only the right have, with a verdict."""
    a, b = left.select(*by, item).distinct().withColumn("_a", F.lit(1)), right.select(*by, item).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, [*by, item], "full").groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in (("both", F.col("_a").isNotNull() & F.col("_b").isNotNull()), ("only_left", F.col("_b").isNull()), ("only_right", F.col("_a").isNull()))))
    verdict = F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "equal").when(F.col("only_right") == 0, "missing_right").when(F.col("only_left") == 0, "missing_left").otherwise("different")
    return n.withColumn("verdict", verdict)


def co_occurrences(rows: DataFrame, by: list[str], name: str, example: Column, least: int = 2) -> DataFrame:
    """Pairs of different names within one group, with the groups that have them (at least `least`) and the first example.

    A group here is a position of a drawing: its names are few by nature; they are made distinct before they are paired.
    """
    one = rows.groupBy(*by, name).agg(F.min(example).alias("_e"))
    a, b = one.select(*by, F.col(name).alias("term_1"), "_e"), one.select(*by, F.col(name).alias("term_2"))
    return a.join(b, by).where("term_1 < term_2").groupBy("term_1", "term_2").agg(F.count(F.lit(1)).alias("occurrences"), F.min("_e").alias("example")).where(F.col("occurrences") >= least)


def overlap_report(rows: DataFrame, section: str, item: str) -> DataFrame:
    """Per section its items and those that no other section has."""
    sections = rows.select(section, item).distinct()
    alone = sections.groupBy(item).agg(F.count(F.lit(1)).alias("_k"))
    return sections.join(alone, item).groupBy(section).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("_k") == 1).alias("exclusive"))


def hits_at(ranked: DataFrame, query: str, relevant: Column, rank: str, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of queries whose first relevant row is among the first k; queries without any relevant row count as misses."""
    first = ranked.groupBy(query).agg(F.min(F.when(relevant, F.col(rank))).alias("_first"))
    return first.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(F.coalesce((F.col("_first") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in ks))


def concept_ranks(ranked: DataFrame, query: str, concept: str, rank: str) -> DataFrame:
    """Concepts of each query in order of their best row, each once."""
    best = ranked.where(F.col(concept).isNotNull()).groupBy(query, concept).agg(F.min(rank).alias("_r"))
    return best.select(query, concept, F.row_number().over(Window.partitionBy(query).orderBy("_r", concept)).alias("concept_rank"))


def stratified(df: DataFrame, by: list[str], key: Column, each: int, always: Column) -> DataFrame:
    """A16-style sample: the `each` rows of every stratum with the smallest hash of their key, and all rows for which `always` holds. The same rows every time."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    return df.withColumns({"_n": n, "_always": always}).where((F.col("_n") <= each) | F.col("_always")).drop("_n", "_always")


def merge_same_drawings(rows: DataFrame) -> DataFrame:
    """Rows (drawing, context, code, position, quantity, validity) of drawings -> one row for each set of drawings that have the same context and the same
    codes, positions and quantities: drawing (the smallest), drawings (how many), context, validities (all of them, in order)."""
    each = rows.groupBy("drawing").agg(F.first("context", ignorenulls=True).alias("context"), F.min("validity").alias("validity"), F.array_sort(F.collect_list(F.struct("code", "position", "quantity"))).alias("_rows"))
    same = each.groupBy("context", F.sha2(F.to_json("_rows"), 256).alias("_signature"))
    return same.agg(F.min("drawing").alias("drawing"), F.count(F.lit(1)).alias("drawings"), F.array_join(F.array_sort(F.collect_set("validity")), ", ").alias("validities")).drop("_signature")
