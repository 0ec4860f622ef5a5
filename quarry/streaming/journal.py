"""The writer of the message log: a stream's batches appended with JSON payloads, replay safe, bad rows aside, never failing the stream."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)
ROLES = ("customer", "bot", "tool")


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value and nothing else: in brackets it must be a list of one."""
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.try_parse_json(c).isNotNull() & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def checked(rows: DataFrame, payloads: list[str]) -> DataFrame:
    """rows with `problem`: why a row can't be logged, or null: no session, an unknown role, or a payload that is no JSON."""
    broken = [F.when(F.col(p).isNotNull() & ~is_json(F.col(p)), F.lit(f"{p} is no JSON")) for p in payloads]
    return rows.withColumn("problem", F.coalesce(F.when(F.col("session").isNull(), "no session"), F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "unknown role"), *broken))


def write_batch(rows: DataFrame, batch: int, target: str, payloads: list[str]) -> None:
    """One batch: good rows to target/log/batch=<id>, the others with their problem to target/aside/batch=<id>. Each folder is the batch's own and is replaced as a
    whole, so a batch that is run again adds nothing. If the log can't be written, the batch is set aside whole and the stream goes on."""
    marked = checked(rows, payloads)
    try:
        marked.where("problem is null").drop("problem").write.mode("overwrite").parquet(f"{target}/log/batch={batch}")
        bad = marked.where("problem is not null")
    except Exception as problem:  # the log must never stop the conversation it is about
        log.exception("batch %s of the log was not written", batch)
        bad = rows.withColumn("problem", F.lit(str(problem)[:500]))
    bad.write.mode("overwrite").parquet(f"{target}/aside/batch={batch}")


def journal(stream: DataFrame, target: str, checkpoint: str, payloads: list[str] | None = None) -> StreamingQuery:
    """Rows (session, role, text, tool, arguments, outcome, ...) of a stream, appended until it has no more."""
    names = payloads if payloads is not None else ["arguments", "outcome"]
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, target, names)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(f"{target}/log")


def set_aside(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, problem string, batch long").parquet(f"{target}/aside")
