"""op1, quality rules: fixed counts per text, then a hashed n-gram logistic regression with calibrated probabilities.

Base: words are `[^\x20\x09-\x0D]+`; word_chars counts code points in words; n_symbols the characters of `[#*$%&|<>]`; n_dup_lines the
lines (split at \\n) with a word that equal an earlier line; n_repeat_words the words in 5-word windows that the text holds twice or
more. Lines and windows are compared by 64-bit hashes together with their text. A text fails the base with fewer than 10 words or with
100 * n_repeat_words > 20 * n_words.

Model: features are word 1- and 2-grams and byte 3- and 4-grams, each kind hashed into BINS and divided by its number in the text, so a
text's logit is a bias plus the mean weight of its n-grams, whatever its length. It is fitted to at most about PER_CLASS labelled rows
of each quality class (a bound on the training rows; chosen by a hash of the id), calibrated by Platt scaling on another such
sample with the classes weighted by their share of all labels, and scored in Arrow batches. A text that passes the base is kept
if its probability of good quality is at least THRESHOLD.

Edge cases: a null or empty text has no words and fails the base, with probability null; labels with null quality or id are left out; with one class of labels, or
none, the model says nothing and the base alone decides (probability null); repeated rows are judged alike; extra columns are
ignored; very long texts are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_VALUE, mix, pieces, span_hashes, string_bytes, texts, word_bounds

BINS = 1 << 16
KINDS = 4
PER_CLASS = 1200
THRESHOLD = 0.2
PIECE = 2 << 20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_B = np.uint64(0x9FB21C651E98DF25)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _window(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * _B + hashes[k : len(hashes) - n + 1 + k])
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base columns of consecutive texts; hashes of all their words; the first word of each text."""
    starts, ends, first = word_bounds(data, offsets)
    n = len(offsets) - 1
    n_words = np.diff(first)
    hashes = span_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(n), n_words)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEAD[data], out=letters[1:])
    chars = np.bincount(text_of, letters[ends] - letters[starts], minlength=n).astype(np.int64)

    cut = data == 10
    if len(starts):
        bounds = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets]))
        a, b = bounds[:-1], bounds[1:].copy()
        b -= cut[np.maximum(b - 1, 0)] & (b > a)  # without its \n
        worded = np.searchsorted(starts, b) > np.searchsorted(starts, a)
        a, b = a[worded], b[worded]
        owner = np.searchsorted(offsets, a, "right") - 1
        key = span_hashes(data, a, b) ^ mix(owner.astype(np.uint64) + np.uint64(77))
        _, once = np.unique(key, return_index=True)
        dup = np.bincount(owner, minlength=n) - np.bincount(owner[once], minlength=n)
    else:
        dup = np.zeros(n, np.int64)

    repeat = np.zeros(n, np.int64)
    if len(hashes) >= 5:
        inside = text_of[:-4] == text_of[4:]
        at = np.flatnonzero(inside)
        key = _window(hashes, 5)[at] ^ mix(text_of[at].astype(np.uint64) + np.uint64(99))
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[many[back] > 1]
        edge = np.zeros(len(hashes) + 6, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + 5, -1)
        covered = np.cumsum(edge)[: len(hashes)] > 0
        repeat = np.bincount(text_of[covered], minlength=n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": dup, "n_repeat_words": repeat}, hashes, first


def grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: the bin of every n-gram start, and per text the range [from, to) of starts that lie within it."""
    shift = np.uint64(48)
    yield (hashes * _B >> shift).astype(np.int64), first[:-1], first[1:]
    two = _window(hashes, 2) if len(hashes) > 1 else hashes[:0]
    yield (two >> shift).astype(np.int64), first[:-1], np.maximum(first[:-1], first[1:] - 1)
    g = BYTE_VALUE[data]
    one = g
    for n in range(2, 5):
        g = g[:-1] * _B + one[n - 1 :]
        if n > 2:
            yield (g * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64), offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)


@dataclass
class QualityModel:
    weights: np.ndarray | None  # (KINDS, BINS)
    bias: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for w, (bins, a, b) in zip(self.weights, grams(data, offsets, hashes, first), strict=True):
            total = np.zeros(len(bins) + 1)
            np.cumsum(w[bins], out=total[1:])
            b = np.minimum(b, len(bins))
            a = np.minimum(a, b)
            out += (total[b] - total[a]) / np.maximum(b - a, 1)
        return out

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.intercept, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows: per text the (kind * BINS + bin) and the share of its kind's n-grams."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        for i, j in pieces(offsets, PIECE):
            piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, hashes, first = base_counts(piece, at)
            found: list[list[np.ndarray]] = [[] for _ in range(j - i)]
            share: list[list[np.ndarray]] = [[] for _ in range(j - i)]
            for kind, (bins, a, b) in enumerate(grams(piece, at, hashes, first)):
                for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    if y > x:
                        which, n = np.unique(bins[x:y], return_counts=True)
                        found[k].append((which + kind * BINS).astype(np.int32))
                        share[k].append((n / (y - x)).astype(np.float32))
            none = [np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label")[i:j], batch.column("fold")[i:j], pa.array([np.concatenate(x or none) for x in found], pa.list_(pa.int32())), pa.array([np.concatenate(x or none).astype(np.float32) for x in share], pa.list_(pa.float32()))],
                names=["label", "fold", "at", "share"],
            )


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """text, label, fold (0 fit, 1 calibrate) of about per_class rows at most per class and fold; all labels per class."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 2 * per_class / v))]), F.col("label")) if sizes else F.lit(0.0)
    # the bound makes the chosen ids small: 4 * per_class rows in expectation
    chosen = marks.where(u < limit).select("doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "label", "fold"), sizes


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = 120) -> QualityModel:
    sample, sizes = labelled_sample(docs, labels, per_class)
    if len(sizes) < 2:
        return QualityModel(None)
    rows = sample.mapInArrow(_features, "label int, fold int, at array<int>, share array<float>").toArrow()
    label, fold = rows.column("label").to_numpy(), rows.column("fold").to_numpy()
    n = rows.column("at").combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = rows.column("at").combine_chunks().flatten().to_numpy().astype(np.int64)
    share = rows.column("share").combine_chunks().flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(n)), n)
    use = (fold == 0)[row]
    if len(np.unique(label[fold == 0])) < 2:
        return QualityModel(None)
    w, bias = np.zeros(KINDS * BINS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    cols, values, rows_ = at[use], share[use], row[use]
    y = label.astype(np.float64)
    weight = np.where(fold == 0, np.where(label == 1, 0.5 / max(1, ((label == 1) & (fold == 0)).sum()), 0.5 / max(1, ((label == 0) & (fold == 0)).sum())), 0.0)
    for t in range(1, rounds + 1):
        z = np.bincount(rows_, w[cols] * values, minlength=len(n)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = np.bincount(cols, g[rows_] * values, minlength=len(w)) + 1e-8 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.7 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        gb = g.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    model = QualityModel(w.reshape(KINDS, BINS), float(bias))
    z = np.bincount(row, w[at] * share, minlength=len(n)) + bias
    held = fold == 1
    if len(np.unique(label[held])) == 2:
        total = sum(sizes.values())
        prior = np.where(label == 1, sizes[1] / total / max(1, (label[held] == 1).sum()), sizes[0] / total / max(1, (label[held] == 0).sum()))[held]
        # Platt's targets keep a separable sample from infinite slopes
        pos, neg = (label[held] == 1).sum(), (label[held] == 0).sum()
        target = np.where(label[held] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        x = np.stack([z[held], np.ones(held.sum())], axis=1)
        theta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
            grad = x.T @ (prior * (p - target))
            hess = (x * (prior * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-9 * np.eye(2)
            theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
        if theta[0] > 0:
            model.slope, model.intercept = map(float, theta)
    return model


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The base counts, base_failed, kept and the calibrated probability of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j in pieces(offsets, PIECE):
                piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                counts, hashes, first = base_counts(piece, at)
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                if shared.value.weights is None:
                    p, mask, good = np.zeros(j - i), np.ones(j - i, bool), np.ones(j - i, bool)
                else:
                    p = np.round(shared.value.probability(shared.value.logits(piece, at, hashes, first)), 6)
                    mask, good = counts["n_words"] == 0, p >= threshold
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(failed), pa.array(good & ~failed), pa.array(p, mask=mask)], names=["doc_id", *counts, "base_failed", "kept", "probability"])

    return texts(docs).mapInArrow(rows, SCHEMA)
