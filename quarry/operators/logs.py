"""Logs of messages and requests: sessions, rates, runs of failures, truncated conversations. All work per key in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.ordering import numbered


def last_turns(messages: DataFrame, conv: str, turn: str, role: str, keep: int) -> DataFrame:
    """The system messages and the last `keep` others, the cut moved forward to a user's turn."""
    newest = Window.partitionBy(conv).orderBy(F.desc(turn))
    rest = messages.where(F.col(role) != "system").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
    cut = rest.groupBy(conv).agg(F.min(F.when(F.col(role) == "user", F.col(turn))).alias("_cut"))
    tail = rest.join(cut, conv).where(F.col(turn) >= F.col("_cut")).drop("_n", "_cut")
    return messages.where(F.col(role) == "system").unionByName(tail)


def idle_sessions(events: DataFrame, key: str, at: Column, gap: int) -> DataFrame:
    """Events with the session they fall into: a new one after more than `gap` seconds without any."""
    w = Window.partitionBy(key).orderBy("_t", "event_id")
    fresh = F.when(F.col("_t") - F.lag("_t").over(w) <= gap, 0).otherwise(1)
    return events.withColumn("_t", at).withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rolling_rate(events: DataFrame, keys: list[str], seconds: Column, span: int) -> DataFrame:
    """Events of the last `span` seconds by the time since the oldest of them (1 at least); 0 with fewer than two."""
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-span, 0)
    n, oldest = F.count(F.lit(1)).over(w), F.min("_t").over(w)
    return events.withColumn("_t", seconds).withColumn("rate", F.when(n < 2, 0.0).otherwise(n / F.greatest(F.lit(1.0), F.col("_t") - oldest)))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """How many failures in a row end at each event; 0 at a success."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = events.withColumn("_island", island).withColumn("_failed", failed.cast("int"))
    within = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("run", F.sum("_failed").over(within)).drop("_island", "_failed")


def backoff(run: Column, most: float) -> Column:
    """The wait after `run` failures: d -> min(most, 1.5 d + 0.05) from 0."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(run, F.lit(1)).cast("int")), F.lit(0.0), lambda d, _: F.least(F.lit(float(most)), d * F.lit(1.5) + F.lit(0.05)))


def evict(sessions: DataFrame, key: str, last: Column, now: Column, idle: int, most: int) -> DataFrame:
    """Sessions that stay: used within `idle` seconds of now, and the `most` newest of those. The limit is a top-k, kept by each task for itself first."""
    live = sessions.withColumn("_last", last).where(now - F.col("_last") <= idle)
    return live.orderBy(F.desc("_last"), key).limit(most).drop("_last")


def queue_order(items: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """Items (queue, item, at) of work queues and the outcomes (item, attempt, ok) of their attempts -> queue, item, attempt, position (from 0, in the order of
    work), ok, state (done, failed).

    A failed item goes back to its queue's end until it has failed `most` times. As a queue is worked off from the front, all first attempts come before all
    second ones, and each round keeps the order of the one before: the position is the place by (attempt, at), numbered over ranges, so that
    a queue of any length is spread. An attempt without an outcome has failed; outcomes after a success, or beyond `most`, are of no attempt.
    """
    good = outcomes.where(F.col("ok") & (F.col("attempt") <= most)).groupBy("item").agg(F.min("attempt").alias("_won"))
    ended = items.select("queue", "item", "at").join(good, "item", "left").withColumn("_last", F.coalesce("_won", F.lit(most)))
    tries = ended.select("queue", "item", "at", "_won", F.explode(F.sequence(F.lit(1), F.col("_last").cast("int"))).alias("attempt"))
    placed = numbered(tries, ["queue"], "attempt", "at", "item", name="position")
    return placed.select("queue", "item", "attempt", "position", F.coalesce(F.col("attempt") == F.col("_won"), F.lit(False)).alias("ok"), F.when(F.col("_won").isNotNull(), "done").otherwise("failed").alias("state"))
