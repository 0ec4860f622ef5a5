"""op11, hard-negative mining with a vector-approximation file: score bounds by table lookup, exact scores only where a window is in reach.

Rows with a null id, label or vector, or a null or non-finite component, take no part. A component x counts as floor(256 * x), a row's score is
its integer inner product with the anchor; higher scores come first, ties by smaller vec_id. Anchors are the rows whose vec_id is divisible by
`ANCHORS`; their positives are the first `POSITIVES` other rows of the same label; for each positive the first `NEGATIVES` rows of other
labels with low * positive_score <= 100 * negative_score <= high * positive_score are mined.

1. The approximation file: rows in pages of PAGE. In a page each dimension is cut into 16 cells of about equally many rows; the page keeps
   each cell's least and greatest component, two cell numbers a byte, and the exact components beside them.
2. An anchor turns a page's cells into a table of least and greatest products for each pair of dimensions. The sums of looked-up entries
   are a lower and an upper bound of every row's score.
3. Positives: a row is scored exactly only if its upper bound reaches the fifth best, so far or by lower bounds. Each cell of
   the grid gives its best five, and these are merged.
4. Negatives: a row is scored exactly only if its bounds reach into the window of one of the anchor's positives, above the tenth best there.

Anchors against all rows is a stated query set in blocks: anchors form groups of ANCHOR_GROUP, pages form slices of at most SLICE_PAGES pages, and
each pair of these is one cell of a grid, bounded in memory whatever the data are: equal vectors, one label or one anchor with a
third of all rows only mean that more rows are scored. No list of partners is cut but by the wanted ranks.

Edge cases: an anchor without positives gives no rows, a positive with an empty window none either (all windows of negative positive scores are
empty); ties in score go to the smaller vec_id; a vec_id on several rows is listed once in a ranking, by its best score (anchors: the
row with the least label and vector), and is never its own partner; shorter vectors count as filled up with zeros, an empty vector
scores 0; components beyond +-2^25 after quantising count as that, so that sums fit a long; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import bound_batches, parts, settle
from quarry.llm.vectors import each, is_finite, matrix, meet, spread

SCALE, LIMIT = 256.0, 1 << 25
ANCHORS, POSITIVES, NEGATIVES, WINDOW = 100, 5, 10, (30, 90)
CELLS = 16
PAGE = 4096
SLICE_PAGES = 64
ANCHOR_GROUP = 4096
#: Anchors whose bounds for one page are held at a time.
BLOCK = 64
LOWEST = np.iinfo(np.int64).min
_PAGE = "at long, wide int, n int, ids binary, labels binary, codes binary, cells binary, vectors binary"


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part, relabelled where vec_id is divisible by 7."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = rows.where(vec_id.isNotNull() & label.isNotNull() & is_finite(F.col("embedding")))
    return rows.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64)


def cells_of(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers of a page's components, and each dimension's least and greatest component by cell (2, dimensions, CELLS)."""
    n, wide = page.shape
    cuts = np.sort(page, axis=0)[(np.arange(1, CELLS) * n) // CELLS]
    codes, bounds = np.zeros((n, wide), np.uint8), np.zeros((2, wide, CELLS), np.int64)
    for d in range(wide):
        codes[:, d] = np.searchsorted(cuts[:, d], page[:, d], "right")
        low, high = np.full(CELLS, LIMIT), np.full(CELLS, -LIMIT)
        np.minimum.at(low, codes[:, d], page[:, d])
        np.maximum.at(high, codes[:, d], page[:, d])
        bounds[:, d] = low, high
    return codes, bounds


def approximation_file(rows: DataFrame) -> DataFrame:
    """Pages of rows: ids, labels, packed cell numbers, cell bounds and exact components."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
            whole = quantised(matrix(batch.column("embedding"))[0])
            if whole.shape[1] % 2 or not whole.shape[1]:
                whole = np.pad(whole, ((0, 0), (0, 1 if whole.shape[1] else 2)))
            for i in range(0, len(ids), PAGE):
                page = whole[i : i + PAGE]
                codes, bounds = cells_of(page)
                packed = np.ascontiguousarray((codes[:, 0::2] * CELLS + codes[:, 1::2]).T)
                kept = (ids[i : i + PAGE], labels[i : i + PAGE], packed, bounds.astype(np.int32), page.astype(np.int32))
                yield pa.RecordBatch.from_pylist([{"at": int(ids[i]), "wide": page.shape[1], "n": len(page)} | {k: x.tobytes() for k, x in zip(("ids", "labels", "codes", "cells", "vectors"), kept)}], _arrow())

    return settle(rows.mapInArrow(pages, _PAGE))


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in _PAGE.split(", "))])


class Page:
    """A page as a task holds it."""

    def __init__(self, row: dict):
        n, wide = row["n"], row["wide"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(wide // 2, n)
        self.cells = np.frombuffer(row["cells"], np.int32).reshape(2, wide, CELLS).astype(np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, wide)

    def bounds(self, anchors: np.ndarray, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of these rows with each anchor, by lookup of two dimensions at a time."""
        y = _fit(anchors, self.cells.shape[1])[:, :, None]
        ends = y * self.cells[0], y * self.cells[1]
        out = []
        for side in (np.minimum(*ends), np.maximum(*ends)):
            pairs = (side[:, 0::2, :, None] + side[:, 1::2, None, :]).reshape(len(anchors), -1, CELLS * CELLS)
            total = np.zeros((len(anchors), len(self.ids[rows])), np.int64)
            for p, codes in enumerate(self.codes):
                total += np.take(pairs[:, p], codes[rows], axis=1)
            out.append(total)
        return out[0], out[1]

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ _fit(anchor[None], self.cells.shape[1])[0]


def _fit(x: np.ndarray, wide: int) -> np.ndarray:
    """The first `wide` dimensions, with zeros for those that are not there: a page has none beyond its own."""
    return x[:, :wide] if x.shape[1] >= wide else np.pad(x, ((0, 0), (0, wide - x.shape[1])))


class Best:
    """The first k (score, id) so far, each id once."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reach(self) -> int:
        """A score below this one can't enter any more."""
        return int(self.scores[-1]) if len(self.ids) == self.k else LOWEST

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        first = np.sort(np.unique(ids[order], return_index=True)[1])[: self.k]
        self.scores, self.ids = scores[order][first], ids[order][first]


def kth_sure(low: np.ndarray, ids: np.ndarray, k: int) -> int:
    """The k-th greatest lower bound, if k different ids stand for it: that many rows score at least this."""
    if len(low) < k:
        return LOWEST
    at = np.argpartition(low, len(low) - k)[len(low) - k :]
    return int(low[at].min()) if len(np.unique(ids[at])) == k else LOWEST


def _anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor_id", "anchor_label"))
    return ids, labels, quantised(matrix(table.column("embedding"))[0])


def find_positives(anchors: pa.Table, pages: pa.Table) -> pa.Table:
    """Each anchor's first rows of its own label among these pages."""
    ids, labels, y = _anchors(anchors) if anchors.num_rows else (np.zeros(0, np.int64),) * 3
    best = [Best(POSITIVES) for _ in ids]
    for row in (r for b in pages.to_batches(max_chunksize=1) for r in b.to_pylist()) if len(ids) else ():
        page = Page(row)
        for label in np.intersect1d(labels, page.labels):
            rows, asked = np.flatnonzero(page.labels == label), np.flatnonzero(labels == label)
            for i in range(0, len(asked), BLOCK):
                block = asked[i : i + BLOCK]
                low, high = page.bounds(y[block], rows)
                for j, a in enumerate(block):
                    other = page.ids[rows] != ids[a]
                    reach = max(best[a].reach(), kth_sure(low[j][other], page.ids[rows][other], POSITIVES))
                    near = rows[other & (high[j] >= reach)]
                    best[a].add(page.scores(y[a], near), page.ids[near])
    return pa.table({"anchor_id": np.repeat(ids, [len(b.ids) for b in best]), "positive_id": _joined(b.ids for b in best), "positive_score": _joined(b.scores for b in best)})


def find_negatives(window: tuple[int, int]):
    """The work of one cell of the grid: each positive's first rows of other labels within its window, among these pages."""

    def ends(score: int) -> tuple[int, int]:
        return -((-window[0] * score) // 100), (window[1] * score) // 100

    def work(anchors: pa.Table, pages: pa.Table) -> pa.Table:
        ids, labels, y = _anchors(anchors) if anchors.num_rows else (np.zeros(0, np.int64),) * 3
        wanted = [[(p["positive_id"], p["positive_score"], *ends(p["positive_score"]), Best(NEGATIVES)) for p in found] for found in anchors.column("positives").to_pylist()]
        for row in (r for b in pages.to_batches(max_chunksize=1) for r in b.to_pylist()) if len(ids) else ():
            page = Page(row)
            for i in range(0, len(ids), BLOCK):
                low, high = page.bounds(y[i : i + BLOCK])
                for j, a in enumerate(range(i, min(len(ids), i + BLOCK))):
                    other = np.flatnonzero(page.labels != labels[a])
                    lows, highs, names = low[j][other], high[j][other], page.ids[other]
                    near = np.zeros(len(other), bool)
                    for _, _, least, most, best in wanted[a]:
                        if least <= most:
                            sure = (lows >= least) & (highs <= most)
                            reach = max(least, best.reach(), kth_sure(lows[sure], names[sure], NEGATIVES))
                            near |= (highs >= reach) & (lows <= most)
                    scores = page.scores(y[a], other[near])
                    for _, _, least, most, best in wanted[a]:
                        inside = (scores >= max(least, best.reach())) & (scores <= most)
                        best.add(scores[inside], names[near][inside])
        found = [(a, p, s, b) for a, of in zip(ids, wanted) for p, s, _, _, b in of]
        n = [len(b.ids) for *_, b in found]
        flat = {"anchor_id": 0, "positive_id": 1, "positive_score": 2}
        return pa.table({c: np.repeat(np.array([f[k] for f in found], np.int64), n) for c, k in flat.items()} | {"negative_id": _joined(b.ids for *_, b in found), "negative_score": _joined(b.scores for *_, b in found)})

    return work


def _joined(arrays: Iterator[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


def mine_negatives(rows: DataFrame, window: tuple[int, int] = WINDOW, every: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = taking_part(rows)
    pages = approximation_file(rows)
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "embedding")).alias("row"))
    anchors = settle(anchors.select("anchor_id", F.col("row.label").alias("anchor_label"), F.col("row.embedding").alias("embedding")))
    n_pages = pages.count()
    n_slices = max(1, min(parts(spark), n_pages), -(-n_pages // SLICE_PAGES))
    n_groups = max(1, -(-anchors.count() // ANCHOR_GROUP))
    placed = pages.withColumn("slice", spread(F.col("at"), F.lit(n_slices))).withColumn("part", each(F.lit(n_groups)))

    def in_grid(asked: DataFrame) -> DataFrame:
        return asked.withColumn("part", spread(F.col("anchor_id"), F.lit(n_groups))).withColumn("slice", each(F.lit(n_slices)))

    near = meet(in_grid(anchors), placed, ["part", "slice"], find_positives, "anchor_id long, positive_id long, positive_score long")
    near = near.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("place", place).where(F.col("place") <= POSITIVES)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = settle(anchors.join(near, "anchor_id"))
    far = meet(in_grid(asked), placed, ["part", "slice"], find_negatives(window), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    far = far.groupBy("anchor_id", "positive_id", "negative_id").agg(F.max("positive_score").alias("positive_score"), F.max("negative_score").alias("negative_score"))
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", place).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({int(SCALE)} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {WINDOW[0]} * positive_score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
