"""What the training-data operators share: tables, the shared folder, and text batches as byte arrays."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definition `[^\x20\x09-\x0D]+` has it.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and one machine does all (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, where the session has not set another size: texts are long, and rows alone do not bound a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it back: what follows neither recomputes it nor needs the executors that made it."""
    spark = df.sparkSession
    bound_batches(spark)
    at = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def let_go(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of tables that nothing refers to any more: it does so when the driver's JVM collects them, which by itself it may
    do when the disk has long been full. What is settled needs none of them."""
    spark.sparkContext._jvm.java.lang.System.gc()


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that returns its documents' columns, for columns of any name: those that Spark would read as paths have plain names inside it."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        odd = [c for c in docs.columns if "." in c or "`" in c]
        if not odd:
            return stage(docs, *args, **kwargs)
        plain = dict(zip(odd, free_names([c for c in docs.columns if c not in odd], *(f"column_{i}" for i in range(len(odd)))), strict=True))
        return stage(docs.toDF(*(plain.get(c, c) for c in docs.columns)), *args, **kwargs).toDF(*docs.columns)

    return run


def parts(spark: SparkSession, times: int = 1) -> int:
    """Shuffle partitions, as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * times)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), further columns by name, and text, with every other column pruned."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in more], F.col("text").cast("string").alias("text"))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets between its values; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `most` bytes: numpy's temporaries stay small whatever the batch; a longer single text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, and the first word of each text (n + 1 indices)."""
    word = ~IS_SEP[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = word[first]  # a word ends with its text, though the next begins with one
    last = first[1:] - 1
    ends[last] = word[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240607)
#: A 64-bit value for each byte and an odd base: hashes are sums of value * base^place modulo 2^64.
BYTE_VALUE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, kept for the largest n so far."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def token_offsets(tokens_per_row: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens_per_row) + 1, np.int64)
    np.cumsum(tokens_per_row, out=out[1:])
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)
