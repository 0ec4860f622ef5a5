"""Upserts and maintenance of tables as DataFrame operations: old and new rows in, the merged table out; writing is one overwrite or one partition swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def _one(df: DataFrame, keys: list[str], seq: str, best) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(best(F.struct(*rest), F.col(seq)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """K1: of rows with one key the one with the highest seq. An aggregation: combined on the map side."""
    return _one(df, keys, seq, F.max_by)


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """K2."""
    return _one(df, keys, seq, F.min_by)


def merge(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """K3, K4: rows of both by key. policy per column: new (the new row's value where there is a new row), old (kept where there is an old row), prefer_new (new unless
    null), prefer_old (old unless null), prefer_new_text (new unless null or empty)."""
    a = old.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_o_{c}") for c in policy])
    b = new.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"_n_{c}") for c in policy])

    def pick(c: str, how: str) -> Column:
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        return {
            "new": F.when(F.col("_b").isNotNull(), n).otherwise(o),
            "old": F.when(F.col("_a").isNotNull(), o).otherwise(n),
            "prefer_new": F.coalesce(n, o),
            "prefer_old": F.coalesce(o, n),
            "prefer_new_text": F.coalesce(F.nullif(n, F.lit("")), o) if how == "prefer_new_text" else n,
        }[how].alias(c)

    return a.join(b, keys, "full").select(*keys, *[pick(c, how) for c, how in policy.items()])


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """K5: all rows of the parents that new holds are replaced."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def drop_vanished(links: DataFrame, seen: DataFrame, children: DataFrame, scope: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """K6: links of the scopes that seen covers which seen no longer holds go, and their children with them; other scopes are left alone."""
    covered = links.join(seen.select(*scope).distinct(), scope, "left_semi")
    gone = covered.join(seen.select(*scope, *key).distinct(), [*scope, *key], "left_anti").select(*scope, *key).distinct()
    return links.join(gone, [*scope, *key], "left_anti"), children.join(gone, [*scope, *key], "left_anti")


def not_done(items: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """K8: what the ledger (key, done_at) does not hold."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def mark_done(ledger: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """K8: the ledger (key, done_at) with the keys of done marked: a key that is there already has its time replaced."""
    marks = done.select("key").distinct().withColumn("done_at", at)
    return ledger.join(marks.select("key"), "key", "left_anti").select("key", "done_at").unionByName(marks)


def to_embed(rows: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose text is new or has changed."""
    old = stored.select(key, F.col(text).alias("_old"), F.lit(True).alias("_known"))
    return rows.join(old, key, "left").where(f"_known is null or not ({text} <=> _old)").drop("_old", "_known")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """K5, K7 on storage: the partitions that df holds are swapped in one job; a failed job leaves the old ones."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def backfill_url(rows: DataFrame, column: str, base: str, catalog: Column, table: Column) -> DataFrame:
    """The missing urls, made from their parts."""
    return rows.withColumn(column, F.coalesce(F.col(column), T.drawing_url(base, catalog, table)))


def export_csv(df: DataFrame, path: str) -> None:
    """Part files for spreadsheets: semicolons, a header each, UTF-8 (the byte-order mark is a zero-width character at the head of the first column's name)."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "﻿" + first).select("﻿" + first, *rest).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def snapshot(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text per key, its rows in order; two snapshots are compared with audit.snapshot_diff."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("value"))
