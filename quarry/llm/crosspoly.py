"""op12, approximate nearest neighbours by cross-polytope hashing: pseudo-rotations, nearest signed axes, multiprobe tables, exact reranking.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null id. Nearness is the cosine in double
precision; the result has each query's `K` nearest found, nearest first, ties by smaller vec_id.

1. Equal vectors are one entry with their K + 1 smallest ids: no query can list more of them, so a vector that a third of all rows hold
   costs as much as any other. Every distinct vector is indexed.
2. A table turns a unit vector by three rounds of random signs and a Hadamard transform (n log n additions), and files it under the signed
   axis nearest to it: the coordinate of greatest absolute value, with its sign. With several polytopes a table's bucket is their axes together.
3. A query looks into the `PROBES` buckets of each table whose axes are nearest to it. Entries and queries of a bucket meet in
   cells of SLICE entries by QUERY_SLICE queries, as many as the bucket's counts ask for, so no bucket has a cap. A cell scores all its pairs
   exactly and gives each query's best K; the union of these is ranked.
4. Queries that found fewer than K look into every bucket of one table, which is an exact search.

TABLES and PROBES are set for random directions, the worst case: on sf0.01 (500 vectors, nearest cosines of 0.27 to 0.45) recall must
be above 0.9; real vectors have nearer neighbours and need fewer. With K polytopes in a table it has (2 * dimensions)^K buckets, for larger inputs.

Edge cases: fewer candidates than K are all returned; repeated rows count once; a vec_id with several vectors asks by the least of them and
is found by its best score, never by itself; vectors of different lengths never meet; very large or small components are scaled by
a power of two, which changes no cosine; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import bound_batches, parts, settle
from quarry.llm.vectors import binary_rows, each, from_binary, is_finite, matrix, meet, slices, spread

K, QUERIES = 5, 50
TABLES, PROBES, POLYTOPES = 16, 7, 1
SLICE, QUERY_SLICE = 8192, 2048
ROUNDS, SEED = 3, 20240811
#: Rows hashed at a time, and scores closer than this are ranked by the exact measure.
BLOCK, CLOSE = 512, 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; their length is a power of two."""
    n, wide, step = len(x), x.shape[1], 1
    while step < wide:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, wide)
        step *= 2
    return x


def turned(unit: np.ndarray, table: int, polytope: int) -> np.ndarray:
    """Rows after this table's pseudo-rotation, filled up to a power of two."""
    wide = 1 << max(0, unit.shape[1] - 1).bit_length()
    signs = np.random.default_rng((SEED, table, polytope, wide)).choice([-1.0, 1.0], (ROUNDS, wide))
    x = np.pad(unit, ((0, 0), (0, wide - unit.shape[1])))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(wide)
    return x


def nearest_axes(unit: np.ndarray, table: int, probes: int = 1, polytopes: int = POLYTOPES) -> np.ndarray:
    """The `probes` nearest buckets of each row, nearest first: the sums over polytopes of the signed coordinates rank them."""
    buckets, worth = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for p in range(polytopes):
        x = turned(unit, table, p)
        signed = np.concatenate([x, -x], axis=1)
        axes = np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        total = worth[:, :, None] + np.take_along_axis(signed, axes, 1)[:, None, :]
        names = buckets[:, :, None] * signed.shape[1] + axes[:, None, :]
        total, names = total.reshape(len(x), -1), names.reshape(len(x), -1)
        order = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        buckets, worth = np.take_along_axis(names, order, 1), np.take_along_axis(total, order, 1)
    return buckets


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y; one pair's value doesn't depend on the others."""
    x, y = np.ascontiguousarray(scaled(x)), np.ascontiguousarray(scaled(y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def hashed(vectors: DataFrame, probes: int, carried: list[str], schema: str) -> DataFrame:
    """A row for each table and probed bucket: dims, tab, bucket, the carried columns, and the vector as float64 bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = pa.Table.from_batches([batch.slice(i, BLOCK)])
                whole, lengths = matrix(part.column("embedding"))
                for dims in np.unique(lengths):
                    at = np.flatnonzero(lengths == dims)
                    x = whole[at, :dims]
                    unit = unit_rows(x)
                    found = [nearest_axes(unit, t, probes) for t in range(TABLES)]
                    kept = part.select(carried).take(at).append_column("vector", binary_rows(x))
                    for t, buckets in enumerate(found):
                        n = buckets.shape[1]
                        out = kept.take(np.repeat(np.arange(len(at)), n))
                        for name, values in (("bucket", buckets.ravel()), ("tab", np.full(len(at) * n, t, np.int32)), ("dims", np.full(len(at) * n, dims, np.int32))):
                            out = out.add_column(0, name, pa.array(values))
                        yield from out.combine_chunks().to_batches()

    return vectors.mapInArrow(rows, f"dims int, tab int, bucket long, {schema}, vector binary")


def nearest_here(k: int):
    """The work of one cell: each query's best k among these entries, by the exact measure."""

    def work(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if entries.num_rows and queries.num_rows:
            x, y = (from_binary(t.column("vector"), "<f8") for t in (entries, queries))
            asked, ids = queries.column("query_id").to_numpy(), entries.column("ids").combine_chunks()
            named, starts = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            ux, uy = unit_rows(x), unit_rows(y)
            for i in range(0, len(y), 256):
                rough = uy[i : i + 256] @ ux.T
                # an entry may be the query itself and nothing else, so k + 1 of them hold the best k rows
                edge = np.partition(rough, rough.shape[1] - k - 1, axis=1)[:, rough.shape[1] - k - 1] if rough.shape[1] > k + 1 else np.full(len(rough), -9.0)
                who, entry = np.nonzero(rough >= edge[:, None] - CLOSE)
                exact = cosines(y[i + who], x[entry])
                n = starts[entry + 1] - starts[entry]
                who, score = np.repeat(who, n), np.repeat(exact, n)
                found = named[np.repeat(starts[entry] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                other = found != asked[i + who]
                who, score, found = who[other], score[other], found[other]
                order = np.lexsort((found, -score, who))
                who, score, found = who[order], score[order], found[order]
                first = np.unique(np.stack([who, found]), axis=1, return_index=True)[1]
                order = np.sort(first)  # each id once, by its best score
                who, score, found = who[order], score[order], found[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                keep = place < k
                for name, values in (("query_id", asked[i + who]), ("vec_id", found), ("score", score)):
                    out[name].append(values[keep])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *v]) for c, v in out.items()})

    return work


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Each vector once, with its smallest ids: one more than a query can list, as it may be one of them."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("place", place).where(F.col("place") <= k + 1)
    return first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, probes: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The best k of every probed cell; counts has a row for each bucket, so their number is bounded by tables and axes, not by rows."""
    bucket = ["dims", "tab", "bucket"]
    asked = probes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("asked"))
    sizes = settle(counts.join(asked, bucket).select(*bucket, slices(F.col("entries"), SLICE).alias("n_slices"), slices(F.col("asked"), QUERY_SLICE).alias("n_parts")))
    entries = hashed(vectors, 1, ["ids"], "ids array<long>").join(F.broadcast(sizes), bucket)
    entries = entries.withColumn("slice", spread(F.col("vector"), F.col("n_slices"))).withColumn("part", each(F.col("n_parts")))
    probes = probes.join(F.broadcast(sizes), bucket).withColumn("part", spread(F.col("query_id"), F.col("n_parts"))).withColumn("slice", each(F.col("n_slices")))
    cell = [*bucket, "slice", "part"]
    return meet(entries.select(*cell, "ids", "vector"), probes.select(*cell, "query_id", "vector"), cell, nearest_here(k), "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, k: int = K, every: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.where(F.col("vec_id").isNotNull() & is_finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("embedding"))
    vectors = settle(distinct_vectors(rows, k))
    asking = settle(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")))
    bucket = ["dims", "tab", "bucket"]
    counts = settle(bucket_counts(vectors))
    probes = hashed(asking, PROBES, ["query_id"], "query_id long")
    found = settle(search(vectors, probes, counts, k))
    few = asking.join(found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    if not few.isEmpty():  # every bucket of the first table: an exact search
        one = hashed(few, 1, ["query_id"], "query_id long").where("tab = 0").drop("bucket")
        found = found.union(search(vectors, one.join(F.broadcast(counts.select(*bucket)), ["dims", "tab"]).select(*bucket, "query_id", "vector"), counts, k))
    found = found.repartition(parts(spark), "query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bucket_counts(vectors: DataFrame) -> DataFrame:
    """How many entries each bucket has; a batch gives its own sums, so that little is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, lengths = matrix(batch.column("embedding"))
            for dims in np.unique(lengths):
                unit = unit_rows(whole[lengths == dims, :dims])
                for t in range(TABLES):
                    names, n = np.unique(nearest_axes(unit, t)[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"dims": np.full(len(n), dims, np.int32), "tab": np.full(len(n), t, np.int32), "bucket": names, "entries": n.astype(np.int64)})

    found = vectors.select("embedding").mapInArrow(sums, "dims int, tab int, bucket long, entries long")
    return found.groupBy("dims", "tab", "bucket").agg(F.sum("entries").alias("entries"))
