"""op10, mixing sources to target weights: iterative proportional fitting, with DataFrame functions alone.

Documents are counted into cells (source, language, topic) by tokens. The cells are raked: their weights are scaled in turn so that
each marginal (source, language, topic) takes its target share of all tokens, for ROUNDS rounds. A
document is then kept with probability rate * weight(cell) / own share of all tokens(cell), against a uniform number
that its id alone decides. So a rerun after a lost executor keeps the same documents.

The rate is lowered to what the scarcest cell can bear, so that no probability is above 1 and no margin is cut short. With `within` (the
pipeline's stage) the cells are raked under that bound until no marginal is off by more than `tolerance`, which keeps more tokens: a scarce
cell's part goes to the others of its margins, and the rate falls only where the targets need it.

Targets: a map from value to share for each axis; values without one share what is left in proportion to their tokens raised to
`alpha` (temperature: 1 keeps the corpus' own shares, 0 makes them equal). With no map this is all values.

The topic of a document, where the table has no such column, is its form: table (bars between cells), shout (capitals and
exclamation marks), symbols (one in 40 characters of #*$%&|<>), or prose.

Scale: texts are read once if they are not asked for (the query), else twice, for the cells and for the sample; only the cells (as many as there are value combinations, a bounded
set that does not grow with documents) are shuffled, pre-aggregated on the map side. Each round of fitting is written to the shared
folder, so the plan stays short. The table of cells goes to the documents by a broadcast up to BROADCAST_CELLS rows, else by a
shuffled join.

Edge cases: a null source, language or topic is a value of its own ('' in the cells); null and empty texts have no tokens, are kept
with their cell's probability, and do not move the weights; cells without tokens are kept at `rate`; repeated rows share a fate (same id, and
so do all rows with a null id); very long texts are counted whole; an empty table gives an empty table; extra columns are left alone; clashing names are
pruned by `mix_sources` and left alone too by `keep_mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import any_names, free_names, settle

AXES = ("source", "lang", "topic")
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 0.9}
RATE = 0.7
ROUNDS = 12
TOLERANCE = 0.01
MOST_ROUNDS = 80
BROADCAST_CELLS = 100_000


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    n = F.length(text)

    def count(chars: str) -> Column:
        left = text
        for c in chars:  # a byte search each
            left = F.replace(left, F.lit(c), F.lit(""))
        return n - F.length(left)

    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "prose")
        .when(count("|") * 25 >= n, "table")
        .when(count("!") * 12 >= n, "shout")
        .when(count("#*$%&|<>") * 40 >= n, "symbols")
        .otherwise("prose")
    )


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that the id and the seed decide: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def _target(cells: DataFrame, axis: str, shares: dict[str, float] | None, alpha: float) -> DataFrame:
    """axis value -> target share; one row for each value."""
    own = cells.groupBy(axis).agg(F.sum("tokens").alias("have")).where(F.col("have") > 0)
    free = F.pow(F.col("have").cast("double"), F.lit(float(alpha)))
    everything = Window.partitionBy(F.lit(1))
    if not shares:
        return own.select(axis, (free / F.sum(free).over(everything)).alias("share"))
    given = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(axis)]
    left = max(0.0, 1.0 - sum(shares.values()))
    loose = F.when(given.isNull(), free).otherwise(0.0)
    share = F.coalesce(given, F.lit(left) * loose / F.sum(loose).over(everything))
    return own.select(axis, share.alias("raw")).select(axis, (F.col("raw") / F.sum("raw").over(everything)).alias("share"))


def _start(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: dict[str, float] | None) -> DataFrame:
    """Cells with tokens, with weight (their own share of all tokens) and the target share of their value on each axis (to_<axis>)."""
    alpha, targets = {**ALPHA, **(alpha or {})}, targets or {}
    total = Window.partitionBy(F.lit(1))
    now = cells.where(F.col("tokens") > 0).withColumn("weight", F.col("tokens") / F.sum("tokens").over(total))
    for axis in AXES:
        now = now.join(F.broadcast(_target(cells, axis, targets.get(axis), alpha[axis]).withColumnRenamed("share", f"to_{axis}")), axis)
    return settle(now)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] | None = None, rounds: int = ROUNDS, every: int = 4) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: shares of all tokens after `rounds` rounds of proportional fitting."""
    now = _start(cells, targets, alpha)
    for i in range(rounds):
        for axis in AXES:
            now = now.withColumn("weight", F.col("weight") * F.col(f"to_{axis}") / F.sum("weight").over(Window.partitionBy(axis)))
        if (i + 1) % every == 0 or i + 1 == rounds:
            now = settle(now)
    return now


def _worst(now: DataFrame, gap: Column) -> float:
    """The largest gap of any value of any axis; gap is an aggregate over the value's cells that may use `to`."""
    each = [now.withColumn("to", F.col(f"to_{axis}")).groupBy(axis).agg(gap.alias("gap")).select("gap") for axis in AXES]
    return each[0].union(each[1]).union(each[2]).agg(F.max("gap")).first()[0] or 0.0


def rake_within(cells: DataFrame, rate: float = RATE, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] | None = None, tolerance: float = TOLERANCE, every: int = 4, most: int = MOST_ROUNDS) -> DataFrame:
    """cells with weight and rate, so that no cell is asked for more than it has (rate * weight <= its own share) and yet each marginal is
    within `tolerance` of its target, as a part of the target.

    Each round scales by the bounded weights, so what one cell cannot give the others of its margin do. The rate starts at what every single
    margin can bear and falls by a twentieth when `every` rounds leave more than 0.7 of the worst gap. Targets that no weights reach end after
    `most` rounds. One scalar for each `every` rounds comes to the driver.
    """
    now = _start(cells, targets, alpha).withColumn("own", F.col("weight"))
    rate = min(rate, 1 / max(1e-9, _worst(now, F.max("to") / F.sum("own")))) if not now.isEmpty() else rate
    last = float("inf")
    for _ in range(0, most, every):
        bounded = F.least("weight", F.col("own") / F.lit(rate))
        for _ in range(every):
            for axis in AXES:
                now = now.withColumn("weight", F.col("weight") * F.col(f"to_{axis}") / F.sum(bounded).over(Window.partitionBy(axis)))
        now = settle(now)
        off = _worst(now, F.abs(F.sum(bounded) / F.max("to") - 1))
        if off <= tolerance:
            break
        if off > 0.7 * last:
            rate, last = rate * 0.95, float("inf")
            now = now.withColumn("weight", F.least("weight", F.col("own") / F.lit(rate)))
        else:
            last = off
    return now.withColumns({"weight": F.least("weight", F.col("own") / F.lit(rate)), "rate": F.lit(rate)})


def _borne(raked: DataFrame, rate: float) -> DataFrame:
    """With rate: the given one, or the least that a cell's own share bears."""
    everything = Window.partitionBy(F.lit(1))
    own = F.col("tokens") / F.sum("tokens").over(everything)
    return raked.withColumn("bears", own / F.col("weight")).withColumn("rate", F.least(F.lit(float(rate)), F.min("bears").over(everything))).drop("bears")


def _chances(cells: DataFrame, targets: dict[str, dict[str, float]] | None, alpha: dict[str, float] | None, rate: float, rounds: int, within: bool, names: list[str]) -> DataFrame:
    """The probability of each cell: its axes and the probability, under the given names."""
    fitted = rake_within(cells, rate, targets, alpha) if within else _borne(rake(cells, targets, alpha, rounds), rate)
    ratio = F.col("weight") / F.col("tokens")
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    p = F.least(F.lit(1.0), F.col("rate") * ratio * everything)
    chance = settle(fitted.select(*[F.col(a).alias(n) for a, n in zip(AXES, names, strict=False)], p.alias(names[-1])))
    return F.broadcast(chance) if chance.count() <= BROADCAST_CELLS else chance


def _axes(topic: str | None) -> dict[str, Column]:
    """The cell of a document: its source, language and topic as text, '' for null."""
    of = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic) if topic else form_topic(F.col("text").cast("string"))}
    return {a: F.coalesce(c.cast("string"), F.lit("")) for a, c in of.items()}


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] | None = None, rate: float = RATE, rounds: int = ROUNDS, seed: int = 7, topic: str | None = None, within: bool = False, columns: list[str] | None = None) -> DataFrame:
    """All columns of docs (those named n_tokens, topic, probability, kept or starting with mix_ aside), or `columns`, with topic, n_tokens,
    probability and kept. Where the text is not among `columns` it is read once: what is known of each document is written down.

    within: fit under the bound that no probability is above 1 (`rake_within`), at a lower rate if need be, so that nothing is cut.
    """
    clash = [c for c in docs.columns if c in ("n_tokens", "probability", "kept") or c.startswith("mix_") or (c == "topic" and topic != "topic")]
    docs, text = docs.drop(*clash), F.col("text").cast("string")
    names = [*(f"mix_{a}" for a in AXES), "mix_p"]
    own = docs.withColumns(dict(zip(names, _axes(topic).values(), strict=False)) | {"topic": F.col(topic) if topic else form_topic(text), "n_tokens": token_count(text)})
    carried = list(dict.fromkeys([*(columns or docs.columns), "topic", "n_tokens"]))
    own = own.select(*carried, *names[:-1])
    if "text" not in carried:
        own = settle(own)
    cells = settle(own.groupBy(*[F.col(f"mix_{a}").alias(a) for a in AXES]).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    p = F.coalesce(F.col("mix_p"), F.lit(float(rate)))
    joined = own.join(_chances(cells, targets, alpha, rate, rounds, within, names), names[:-1], "left")
    return joined.select(*carried, p.alias("probability"), (uniform(F.col("doc_id"), seed) < p).alias("kept"))


@any_names
def keep_mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] | None = None, rate: float = RATE, seed: int = 7, topic: str | None = None) -> DataFrame:
    """The sampled documents with their own columns, whatever their names, by probabilities that are nowhere above 1 (`rake_within`)."""
    counted = docs.select(*[c.alias(a) for a, c in _axes(topic).items()], token_count(F.col("text").cast("string")).alias("n"))
    cells = settle(counted.groupBy(*AXES).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    names = free_names(docs.columns, *(f"mix_{a}" for a in AXES), "mix_p")
    wide = docs.withColumns(dict(zip(names, _axes(topic).values(), strict=False)))
    p = F.coalesce(F.col(names[-1]), F.lit(float(rate)))
    return wide.join(_chances(cells, targets, alpha, rate, 0, True, names), names[:-1], "left").where(uniform(F.col("doc_id"), seed) < p).select(*docs.columns)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, text,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'prose'
      WHEN (length(text) - length(replace(text, '|', ''))) * 25 >= length(text) THEN 'table'
      WHEN (length(text) - length(replace(text, '!', ''))) * 12 >= length(text) THEN 'shout'
      WHEN (length(text) - length(translate(text, '#*$%&|<>', ''))) * 40 >= length(text) THEN 'symbols'
      ELSE 'prose' END AS topic,
    coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0) AS n_tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
t AS (SELECT c.*,
    tokens / sum(tokens) OVER () AS w0,
    s.x / (SELECT sum(x) FROM (SELECT pow(sum(tokens), 0.5) AS x FROM c GROUP BY source)) AS ts,
    l.x / (SELECT sum(x) FROM (SELECT pow(sum(tokens), 0.7) AS x FROM c GROUP BY lang)) AS tl,
    o.x / (SELECT sum(x) FROM (SELECT pow(sum(tokens), 0.9) AS x FROM c GROUP BY topic)) AS tt
  FROM c JOIN (SELECT source, pow(sum(tokens), 0.5) AS x FROM c GROUP BY source) s USING (source)
    JOIN (SELECT lang, pow(sum(tokens), 0.7) AS x FROM c GROUP BY lang) l USING (lang)
    JOIN (SELECT topic, pow(sum(tokens), 0.9) AS x FROM c GROUP BY topic) o USING (topic)),
r AS (
  SELECT 0 AS i, source, lang, topic, tokens, ts, tl, tt, w0 AS w FROM t
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * tl / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * ts / sum(w) OVER (PARTITION BY source) AS w) FROM r WHERE i < 12))),
z AS (SELECT source, lang, topic, tokens, w, sum(tokens) OVER () AS total FROM r WHERE i = 12),
p AS (SELECT source, lang, topic, least(1.0, least(0.7, (SELECT min(tokens / total / w) FROM z)) * (w / tokens) * total) AS p FROM z)
SELECT d.doc_id, d.topic, d.n_tokens::BIGINT AS n_tokens, round(coalesce(p, 0.7), 6) AS probability,
  ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < coalesce(p, 0.7) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
"""
