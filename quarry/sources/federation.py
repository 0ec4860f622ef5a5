"""Catalogs of several makers as one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Opener = Callable[[], DataFrame]


def open_sources(openers: dict[str, Opener]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sources that open, and why the others do not: a missing table or column leaves out its source alone. Other errors go on."""
    opened: dict[str, DataFrame] = {}
    broken: dict[str, str] = {}
    for name, opener in openers.items():
        try:
            opened[name] = opener()
        except AnalysisException as e:
            broken[name] = str(e)
    return opened, broken


def federated(openers: dict[str, Opener]) -> DataFrame:
    """All rows of the sources that open, with the source's name as brand; columns that a source lacks are null. Without any source an error."""
    opened, broken = open_sources(openers)
    if not opened:
        raise ValueError(f"no source opens: {broken}")
    branded = [df.withColumn("brand", F.lit(name)) for name, df in opened.items()]
    whole = branded[0]
    for df in branded[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole


def ask_all(requests: DataFrame, finders: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Requests (request, ...) put to every source (name -> requests -> found rows with request). Returns an outcome for each request: `one` with its brand, `many`
    (the customer must say which) with all brands, or `none` (the brand must be asked for); and the rows found, with their brand, where the brand
    is one. A source that does not open answers nothing."""
    opened, _ = open_sources({name: lambda f=finder: f(requests) for name, finder in finders.items()})
    asked = requests.select("request").distinct()
    if not opened:
        return asked.withColumns({"outcome": F.lit("none"), "brands": F.array().cast("array<string>")}), asked.limit(0).withColumn("brand", F.lit(""))
    rows = federated({name: lambda df=df: df for name, df in opened.items()})
    brands = rows.groupBy("request").agg(F.array_sort(F.collect_set("brand")).alias("brands"))  # no more than there are sources
    outcome = F.when(F.col("brands").isNull(), "none").when(F.size("brands") == 1, "one").otherwise("many")
    found = asked.join(brands, "request", "left").select("request", outcome.alias("outcome"), F.coalesce("brands", F.array().cast("array<string>")).alias("brands"))
    return found, rows.join(found.where("outcome = 'one'").select("request"), "request", "left_semi")
