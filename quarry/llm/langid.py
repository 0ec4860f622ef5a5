"""op7, language identification: one interpolated Kneser-Ney character model per language, in sorted hash arrays.

Text is read as letters in lower case; a run of anything else is one blank; three blanks stand before each text. For each language the
model holds, for the orders 1 to 4, the interpolated probability of every n-gram seen, and for each history its back-off weight, both
in arrays sorted by 64-bit hash and searched by bisection. A text's score under a language is its cross-entropy per letter (natural
logarithm); the language with the lowest is predicted (ties: the first by name).

Training takes texts with a known language whose crc32(doc_id as text) mod 3 is not 1: remainder 0 to count n-grams, remainder 2 to
calibrate, each a hash-sample of at most about `per_language` texts of each language (a bound on the classifier's training rows; the
default is PER_LANGUAGE). Calibration sets
  - the temperature of `score`, the softmax of minus the cross-entropies, by likelihood over a grid;
  - per language the mean, and the variance as a + b / letters, of the right model's cross-entropy, and the mean of the best wrong
    model's. A text is rejected if its cross-entropy exceeds the mean by more than both six standard deviations for its length and
    half the way to the wrong models' mean.

Whole texts are scored. Edge cases: a null text, or one without letters, is `und` with score 0, and rejected; very short texts have wide
limits and are hardly ever rejected; a language that calibration has not seen takes the pooled limits; with no training rows at all every text is `und`; repeated
rows are scored alike; extra columns are ignored; rows with a null doc_id are scored but neither trained on nor held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import any_names, mix, pieces, settle, string_bytes, texts

ORDER = 4
PER_LANGUAGE = 1500
PIECE = 1 << 18
_B = np.uint64(0xD6E8FEB86659FD93)
_lut: dict[str, np.ndarray] = {}


def letters_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for all else."""
    if "lut" not in _lut:
        lut = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                lut[i] = ord(low) if len(low) == 1 else i
        _lut["lut"] = lut
    return _lut["lut"]


def letter_stream(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded streams of letters and single blanks, end to end; where each text starts (n + 1); letters per text."""
    lens = np.fromiter((len(t) if t else 0 for t in batch), np.int64, len(batch))
    points = np.frombuffer("".join(t for t in batch if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters_table()[points]
    at = np.zeros(len(batch) + 1, np.int64)
    np.cumsum(lens, out=at[1:])
    letter = low != 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    starts = at[:-1][lens > 0]
    keep[starts] = letter[starts]
    kept_before = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    letters_before = np.zeros(len(low) + 1, np.int64)
    np.cumsum(letter, out=letters_before[1:])
    pad = ORDER - 1
    to = kept_before[at] + pad * np.arange(len(batch) + 1)
    out = np.zeros(to[-1], np.uint32)
    row = np.repeat(np.arange(len(batch)), lens)[keep]
    out[kept_before[:-1][keep] + pad * (row + 1)] = low[keep]
    return out, to, np.diff(letters_before[at])


def gram_hashes(stream: np.ndarray) -> list[np.ndarray]:
    """For k = 1 .. ORDER the hash of the k symbols that end at each place (shorter at the very start)."""
    one = mix(stream.astype(np.uint64) + np.uint64(0x1234567))
    out = [one]
    for _ in range(ORDER - 1):
        g = out[-1]
        longer = one.copy()
        longer[1:] += g[:-1] * _B
        out.append(longer)
    return out


def _hash_symbols(grams: np.ndarray) -> np.ndarray:
    """The same hash of rows of symbols (n, k)."""
    one = mix(grams.astype(np.uint64) + np.uint64(0x1234567))
    h = one[:, 0]
    for k in range(1, grams.shape[1]):
        h = h * _B + one[:, k]
    return h


@dataclass
class CharModel:
    """grams[k - 1]: (sorted hashes, log probability) of order k; histories[k - 1]: (sorted hashes, log back-off weight) of k symbols."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    histories: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def log_probability(self, by_order: list[np.ndarray], history: list[np.ndarray]) -> np.ndarray:
        """by_order[k - 1]: hash of the k-gram that ends here; history[k - 1]: hash of the k symbols before."""
        n = len(by_order[0])
        out, weight, todo = np.full(n, self.floor), np.zeros(n), np.ones(n, bool)
        for k in range(ORDER, 0, -1):
            keys, p = self.grams[k - 1]
            at = np.minimum(np.searchsorted(keys, by_order[k - 1]), len(keys) - 1)
            hit = todo & (keys[at] == by_order[k - 1])
            out[hit] = p[at[hit]] + weight[hit]
            todo &= ~hit
            if k > 1:
                keys, g = self.histories[k - 2]
                at = np.minimum(np.searchsorted(keys, history[k - 2]), len(keys) - 1)
                seen = keys[at] == history[k - 2]
                weight[seen] += g[at[seen]]
        out[todo] = self.floor + weight[todo]
        return out


def train(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> CharModel:
    """Interpolated Kneser-Ney from counts of the n-grams of the highest order (n, ORDER). alphabet: symbols, unseen ones included."""
    levels: list[tuple[np.ndarray, np.ndarray]] = [(grams, counts.astype(np.float64))]
    for _ in range(ORDER - 1):  # lower orders count the distinct symbols that come before
        shorter, n = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (shorter, n.astype(np.float64)))
    tables, weights = [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    floor = 0.0
    for k, (g, c) in enumerate(levels, 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if k == 1:
            total = c.sum()
            gamma = d * len(c) / total
            p = np.maximum(c - d, 0) / total + gamma / alphabet
            floor = float(np.log(gamma / alphabet))
        else:
            _, back, n = np.unique(g[:, :-1], axis=0, return_inverse=True, return_counts=True)
            back = back.ravel()
            total = np.bincount(back, c)
            gamma = d * n / total
            keys, q = below
            lower = np.exp(q[np.searchsorted(keys, _hash_symbols(g[:, 1:]))])
            p = np.maximum(c - d, 0) / total[back] + gamma[back] * lower
            first = np.zeros(len(n), np.int64)
            first[back[::-1]] = np.arange(len(g))[::-1]
            h = _hash_symbols(g[first][:, :-1])
            order = np.argsort(h)
            weights.append((h[order], np.log(gamma[order])))
        h = _hash_symbols(g)
        order = np.argsort(h)
        below = (h[order], np.log(p[order]))
        tables.append(below)
    return CharModel(tables, weights, floor)


@dataclass
class Identifier:
    languages: list[str]
    models: list[CharModel]
    temperature: float = 1.0
    limits: np.ndarray | None = None  # per language: mean, a, b, mean of the best wrong model

    def cross_entropies(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) in nats a symbol, and letters per text. A table of n-grams met so far spares the bisections."""
        stream, at, letters = letter_stream(batch)
        out = np.zeros((len(batch), len(self.models)))
        lens = np.diff(at) - (ORDER - 1)
        if not len(stream):
            return out, letters
        h = gram_hashes(stream)
        scored = np.ones(len(stream), bool)
        scored[(at[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
        place = np.flatnonzero(scored)
        if not len(place):
            return out, letters
        cache = self.__dict__.setdefault("_cache", (np.zeros(1 << 18, np.uint64), np.zeros((1 << 18, len(self.models)))))
        key = h[-1][place]
        slot = (key >> np.uint64(46)).astype(np.int64)
        miss = np.flatnonzero(cache[0][slot] != key)
        got = cache[1][slot]
        if len(miss):
            _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            where = place[miss[first]]
            grams, before = [x[where] for x in h], [x[where - 1] for x in h]
            fresh = np.stack([m.log_probability(grams, before) for m in self.models], axis=1)
            got[miss] = fresh[back]
            to = slot[miss[first]]
            cache[0][to] = key[miss[first]]
            winner = cache[0][to] == key[miss[first]]
            cache[1][to[winner]] = fresh[winner]
        full = lens > 0
        begin = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=begin[1:])
        out[full] = -np.add.reduceat(got, begin[full], axis=0) / lens[full, None]
        return out, letters

    def predict(self, batch: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, of each text."""
        if not self.models:
            n = len(batch)
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        ce, letters = self.cross_entropies(batch)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best] if len(ce) else np.zeros(0)
        p = np.exp(-(ce - low[:, None]) * self.temperature)
        score = 1 / p.sum(axis=1)
        none = letters == 0
        score[none] = 0
        rejected = none.copy()
        if self.limits is not None:
            mean, a, b, wrong = self.limits[best].T
            slack = np.maximum(6 * np.sqrt(a + b / np.maximum(letters, 1)), (wrong - mean) / 2)
            rejected |= low > mean + slack
        return ["und" if z else self.languages[i] for i, z in zip(best.tolist(), none.tolist(), strict=True)], np.clip(score, 0, 1), low, rejected


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _by_piece(texts_: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts_):
        size += len(t or "")
        if size >= PIECE:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts_):
        yield i, len(texts_)


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offsets = string_bytes(column)
    for i, j in pieces(offsets, PIECE):
        yield i, j, column[i:j].to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, k in zip(all_texts, langs, strict=True) if k == lang]
            for i, j in _by_piece(own):
                stream, at, _ = letter_stream(own[i:j])
                h = gram_hashes(stream)[-1]
                scored = np.ones(len(stream), bool)
                scored[(at[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
                place = np.flatnonzero(scored)
                _, first, n = np.unique(h[place], return_index=True, return_counts=True)
                where = place[first]
                grams = pa.FixedSizeListArray.from_arrays(pa.array(stream[where[:, None] + np.arange(1 - ORDER, 1)].ravel().astype(np.int64)), ORDER)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(grams.values.to_numpy()[i::ORDER]) for i in range(ORDER)), pa.array(n.astype(np.int64))], names=["lang", *(f"c{i}" for i in range(ORDER)), "n"])


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, fold (0 train, 2 calibrate), text: about per_language texts at most of each language and fold, chosen by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).withColumn("fold", remainder(F.col("doc_id"))).where("fold <> 1")
    sizes = known.groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("size"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return settle(known.join(F.broadcast(sizes), ["lang", "fold"]).where(u * F.col("size") < per_language).select("lang", "fold", "text"))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier:
    """Counts on the executors; the models, whose size the sample bounds, are made on the driver."""
    sample = training_sample(docs, per_language)
    symbols = [f"c{i}" for i in range(ORDER)]
    counted = sample.where("fold = 0").select("lang", "text").mapInArrow(_count, "lang string, " + ", ".join(f"{c} long" for c in symbols) + ", n long").groupBy("lang", *symbols).agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    seen = len(np.unique(counted[symbols].to_numpy())) if len(counted) else 0
    models = []
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values(symbols)
        models.append(train(own[symbols].to_numpy(), own["n"].to_numpy(), seen + 1000))
    found = Identifier(languages, models)
    if not models:
        return found

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for i, j in _by_piece(all_texts):
                ce, n = found.cross_entropies(all_texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(langs[i:j]), pa.array(n), pa.array(ce.tolist(), pa.list_(pa.float64()))], names=["lang", "letters", "ce"])

    rows = sample.where("fold = 2").select("lang", "text").mapInArrow(evaluate, "lang string, letters long, ce array<double>").where("letters > 0").toPandas().sort_values(["lang", "letters"])
    rows = rows[rows["lang"].isin(languages)]
    if not len(rows):
        return found
    ce, truth = np.stack(rows["ce"].to_list()), np.array([languages.index(x) for x in rows["lang"]])
    letters = rows["letters"].to_numpy().astype(np.float64)
    right = ce[np.arange(len(ce)), truth]

    def likelihood(t: float) -> float:
        return float((-(right * t) - np.log(np.exp(-(ce - ce.min(axis=1, keepdims=True)) * t).sum(axis=1)) + ce.min(axis=1) * t).sum())

    found.temperature = max((0.5, 1, 2, 4, 8, 16, 32), key=likelihood)
    wrong = ce.copy()
    wrong[np.arange(len(ce)), truth] = np.inf
    wrong = np.where(np.isfinite(wrong.min(axis=1)), wrong.min(axis=1), right + 2)

    def limit(mask: np.ndarray) -> np.ndarray:
        weight = letters[mask] / letters[mask].sum()
        mean = float((right[mask] * weight).sum())
        off = (right[mask] - mean) ** 2
        x = np.stack([np.ones(mask.sum()), 1 / letters[mask]], axis=1)
        w = np.sqrt(letters[mask])[:, None]
        a, b = np.linalg.lstsq(x * w, off * w[:, 0], rcond=None)[0]
        return np.array([mean, max(a, 1e-4), max(b, 1.0), float(wrong[mask].mean())])

    pooled = limit(np.ones(len(right), bool))
    found.limits = np.stack([limit(truth == i) if (truth == i).sum() >= 20 else pooled for i in range(len(languages))])
    return found


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, some in _pieces(batch.column("text")):
                lang, score, ce, rejected = shared.value.predict(some)
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(lang, pa.string()), pa.array(score), pa.array(ce), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    found = texts(docs).mapInArrow(rows, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@any_names
def keep_identified(docs: DataFrame, model: Identifier) -> DataFrame:
    """The documents that are not rejected, with their own columns; lang, if null, is filled with the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, some in _pieces(batch.column("text")):
                lang, _, _, rejected = shared.value.predict(some)
                part = batch.slice(i, j - i)
                if "lang" in columns:
                    at = columns.index("lang")
                    filled = part.column(at).cast(pa.string()).to_pylist()
                    part = part.set_column(at, "lang", pa.array([x if x is not None else y for x, y in zip(filled, lang, strict=True)], pa.string()))
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(rows, docs.schema)
