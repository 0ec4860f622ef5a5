"""op4, suffix-array dedup: every byte covered by a LENGTH-byte string that also starts earlier is removed.

"Earlier" is a smaller doc_id, or the same document and an earlier start. Strings do not cross documents and are judged on the input.

A full suffix array of the corpus would shuffle every suffix. Sorting only some suffixes is enough if equal strings always choose the
same ones: of the LENGTH - GRAM + 1 places in a string where a GRAM-byte token group may start, the one with the smallest hash (the
leftmost on a tie) is the string's anchor. Equal strings have their anchors at the same place within them, and successive strings of a
text share theirs, so only one suffix in about forty is sorted, and each speaks for a run of consecutive strings.

1. Sampled splitters: the leading 8 bytes of a sample of anchored suffixes are cut into equal ranges. They grow with neither the
   input nor its size, and equal leading bytes never fall into two ranges, so no run of equal strings crosses a boundary.
2. Each suffix goes to the range of its leading bytes as a short row: token group, fingerprint of all the strings it speaks for, place.
   Before that, each batch keeps only the first of the suffixes with equal fingerprints; the strings of the others are removed there
   and then, so that a group of copies, however large, arrives as a few rows a task.
3. A range sorts its rows by token group and fingerprint. All but the first of equal fingerprints are removed whole. Where one token
   group has several fingerprints (the ends of a shared passage), the first of each fetches its bytes from its document.
4. Those strings go to the ranges again and are sorted by multikey quicksort: 8 bytes a step, each step only within the runs that are still
   equal, the strings' ends before their middles since the middles hold the common token group. In each run of equal strings all but
   the earliest are removed. A token group with more rows than BLOCK is sorted in blocks, with the strings of earlier blocks remembered as 64-bit hashes.
5. Spans are joined to their documents, merged, and cut out.

Fingerprints are 64-bit hashes within one token group's 64-bit hash. The text is shuffled once, by doc_id, for steps 3 and 5 together
(the plan reuses the exchange).

Edge cases: null and empty texts, and those shorter than LENGTH, lose nothing; rows that repeat a doc_id with the same text are one document and get
equal results; with different texts they are documents in the order of the texts' hash; a null doc_id comes before all others;
very long texts are cut into overlapping pieces of windows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_VALUE, gather, mix, parts, powers, string_bytes, texts

LENGTH = 100
GRAM = 24
PIECE = 1 << 21
BLOCK = 100_000
SAMPLE_TEXTS = 2000
_INDEX_BITS = np.uint64(28)
_INDEX = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchored suffixes of consecutive texts: text, at (place of the anchor in data), low and high (first and last start of the strings
    it speaks for), group (hash of the token group), print (of data[low : high + length] and the anchor's place in it)."""
    none = {k: np.zeros(0, np.uint64 if k in ("group", "print") else np.int64) for k in ("text", "at", "low", "high", "group", "print")}
    n = len(data)
    if n < length:
        return none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    low = (hashes & ~_INDEX) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    sizes = np.diff(offsets)
    starts_per = np.maximum(sizes - length + 1, 0)
    start = gather(offsets[:-1], starts_per)
    if not len(start):
        return none
    text = np.repeat(np.arange(len(sizes)), starts_per)
    place = (low[start] & _INDEX).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    at, begin, end = place[first], start[first], start[last]
    tag = mix((sums[end + length] - sums[begin]) * down[begin] + ((at - begin) << 8 | (at - end)).astype(np.uint64))
    return {"text": text[first], "at": at, "low": begin, "high": end, "group": np.maximum(hashes[at], np.uint64(1)), "print": tag}


def lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as a number that sorts like them."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _windows(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, skip, size): texts [i, j), of which the first is read from byte skip, and size bytes of it; long texts come in overlapping pieces."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
        if j > i:
            yield i, j, 0, int(offsets[j] - offsets[i])
            i = j
        else:
            size = int(offsets[i + 1] - offsets[i])
            for skip in range(0, max(1, size - length + 1), PIECE):
                yield i, i + 1, skip, min(size - skip, PIECE + length - 1)
            i += 1


def _spans(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans sorted by (id, begin)."""
    if not len(ids):
        return ids, begin, end
    key = np.r_[True, ids[1:] != ids[:-1]]
    block = np.cumsum(key) - 1
    # ends grow within an id; a constant per id keeps ids apart in one running maximum
    big = int(end.max()) + 1
    top = np.maximum.accumulate(end + block * big) - block * big
    fresh = key.copy()
    fresh[1:] |= begin[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    return ids[first], begin[first], top[np.r_[first[1:], len(ids)] - 1]


ROWS = "bucket int, grp long, tag long, did long, th long, pos long"


def _extract(splitters: np.ndarray, length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.lexsort((batch.column("th").to_numpy(), batch.column("did").to_numpy()))
            batch = batch.take(pa.array(order))
            did, th = batch.column("did").to_numpy(), batch.column("th").to_numpy()
            data, offsets = string_bytes(batch.column("text"))
            found: list[dict[str, np.ndarray]] = []
            for i, j, skip, size in _windows(offsets, length):
                a = offsets[i] + skip
                piece = data[a : a + size]
                got = anchors(piece, np.minimum(np.maximum(offsets[i : j + 1] - a, 0), size), length, gram)
                got["bucket"] = np.searchsorted(splitters, lead(piece, got["at"]), "right") if len(got["at"]) else got["at"]
                inner = offsets[got["text"] + i] - a  # a text's start, seen from the piece
                for k in ("at", "low", "high"):
                    got[k] = got[k] - inner
                got["text"] = got["text"] + i
                found.append(got)
            if not found:
                continue
            x = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            both = x["print"] ^ mix(x["group"])
            _, first, back = np.unique(both, return_index=True, return_inverse=True)
            keep = np.zeros(len(both), bool)
            keep[first] = True
            rep = first[back]
            t, r = x["text"], x["text"][rep]
            same = (did[t] == did[r]) & (th[t] == th[r]) & (x["at"] == x["at"][rep])  # a repeated row
            gone = ~keep & ~same
            st, sb, se = _spans(t[gone], x["low"][gone], x["high"][gone] + length)
            pos = x["at"] << 14 | (x["at"] - x["low"]) << 7 | (x["at"] - x["high"])
            cols = [
                np.concatenate([x["bucket"][keep], st % max(1, len(splitters) + 1)]).astype(np.int32), np.concatenate([x["group"][keep].view(np.int64), np.zeros(len(st), np.int64)]), np.concatenate([x["print"][keep].view(np.int64), se]),
                np.concatenate([did[t[keep]], did[st]]), np.concatenate([th[t[keep]], th[st]]), np.concatenate([pos[keep], sb]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "grp", "tag", "did", "th", "pos"])

    return rows


def _first_of_each(length: int):
    """Rows sorted by (grp, tag, did, th, pos) -> spans (grp 0, a = start, b = end) and requests (a = pos)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # grp, tag, did, th, pos of the row before
        held: tuple | None = None  # the first row of its group, while its group has but one fingerprint
        for batch in batches:
            g, c, d, h, p = (batch.column(k).to_numpy() for k in ("grp", "tag", "did", "th", "pos"))
            span = g == 0
            out = [(np.zeros(int(span.sum()), np.int64), d[span], h[span], p[span], c[span])]
            g, c, d, h, p = (x[~span] for x in (g, c, d, h, p))
            if len(g):
                lg, lc, ld, lh, lp = last or (0, 0, 0, 0, -1)
                pg, pc, pd_, ph, pp = (np.r_[a, b[:-1]] for a, b in ((lg, g), (lc, c), (ld, d), (lh, h), (lp, p)))
                new_group = g != pg
                first = new_group | (c != pc)
                gone = ~first & ~((d == pd_) & (h == ph) & (p == pp))
                at, lo, hi = p[gone] >> 14, p[gone] >> 7 & 127, p[gone] & 127
                out.append((np.zeros(len(at), np.int64), d[gone], h[gone], at - lo, at - hi + length))
                f = np.flatnonzero(first)
                if len(f):
                    run = np.cumsum(np.r_[True, g[f][1:] != g[f][:-1]]) - 1
                    size = np.bincount(run)
                    carried = last is not None and not new_group[f[0]]
                    if carried:  # its group began in an earlier batch
                        size[0] += 1
                        if held is not None:
                            out.append(tuple(np.array([v]) for v in held))
                            held = None
                    multi = size[run] > 1
                    if last is not None and not carried:
                        held = None
                    e = f[multi]
                    out.append((g[e], d[e], h[e], p[e], np.zeros(len(e), np.int64)))
                    if not multi[-1]:
                        z = f[-1]
                        held = (g[z], d[z], h[z], p[z], 0)
                    else:
                        held = None
                last = (g[-1], c[-1], d[-1], h[-1], p[-1])
            grp, did, th, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did, th, grp, a, b)], names=["did", "th", "grp", "a", "b"])

    return rows


CONTEXT = "bucket int, grp long, did long, th long, pos long, body binary"


def _contexts(splitters: np.ndarray, length: int):
    """Documents with their items (grp, a, b) -> the bytes of each request; spans go along, with their end as body."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
            for i in range(len(batch)):
                items = batch.column("items")[i].values
                grp, a, b = (items.field(k).to_numpy() for k in ("grp", "a", "b"))
                raw = batch.column("text")[i].as_buffer()
                data = np.frombuffer(raw, np.uint8)
                whole = raw.to_pybytes()
                s = grp == 0
                order = np.argsort(a[s], kind="stable")
                _, begin, end = _spans(np.zeros(int(s.sum()), np.int64), a[s][order], b[s][order])
                want = np.unique(np.stack([a[~s], grp[~s]], axis=1), axis=0)
                at = want[:, 0] >> 14
                lo, hi = at - (want[:, 0] >> 7 & 127), at - (want[:, 0] & 127) + length
                bucket = np.searchsorted(splitters, lead(data, at), "right") if len(at) else at
                cols[0] += [*bucket.tolist(), *[i % (len(splitters) + 1)] * len(begin)]
                cols[1] += [*want[:, 1].tolist(), *[0] * len(begin)]
                cols[2] += [dids[i]] * (len(at) + len(begin))
                cols[3] += [ths[i]] * (len(at) + len(begin))
                cols[4] += [*want[:, 0].tolist(), *begin.tolist()]
                cols[5] += [*(whole[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)), *(int(e).to_bytes(8, "little") for e in end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return rows


def multikey_runs(data: np.ndarray, start: np.ndarray, run: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings data[s : s + length] within runs (numbers) by 8-byte tokens, going on only where all tokens so far are equal.

    Returns the indices of strings that equal another of their run, run by run in their first order, and the number of the equal run.
    """
    places = [*range(0, length - 7, 8)]
    if length % 8:
        places.append(max(0, length - 8))
    places = [p for pair in zip(places, reversed(places), strict=True) for p in pair]
    idx, seen = np.arange(len(start)), set()
    order = np.argsort(run, kind="stable")
    idx, run = idx[order], run[order]
    for p in places:
        if p in seen:
            continue
        seen.add(p)
        word = np.zeros(len(idx), np.uint64)
        for k in range(min(8, length)):
            word = word << np.uint64(8) | data[start[idx] + (p + k)].astype(np.uint64)
        order = np.lexsort((word, run))
        idx, run, word = idx[order], run[order], word[order]
        fresh = np.r_[True, (run[1:] != run[:-1]) | (word[1:] != word[:-1])] if len(idx) else np.zeros(0, bool)
        run = np.cumsum(fresh) - 1
        many = np.bincount(run, minlength=1)[run] > 1 if len(idx) else fresh
        idx, run = idx[many], run[many]
        if not len(idx):
            break
    return idx, run


def _sorted_blocks(length: int, most: int = BLOCK):
    """Rows sorted by (grp, did, th, pos) -> spans (did, th, s, e) of strings that are not the earliest of their kind."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of a group whose end has not come
        seen: np.ndarray | None = None  # hashes of the strings of earlier blocks of group `of`
        of = 0

        def solve(block: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
            grp, did, th, pos = (block.column(k).to_numpy() for k in ("grp", "did", "th", "pos"))
            data, offsets = string_bytes(block.column("body"))
            at, lo, hi = pos >> 14, pos >> 7 & 127, pos & 127
            count = lo - hi + 1
            owner = np.repeat(np.arange(len(grp)), count)
            start = gather(offsets[:-1], count)
            shift = lo[owner] - (start - offsets[:-1][owner])  # anchor's place in the string
            run = np.cumsum(np.r_[True, grp[1:] != grp[:-1]])[owner] * 128 + shift
            idx, equal = multikey_runs(data, start, run, length)
            later = np.zeros(len(start), bool)
            if len(idx):
                later[idx[1:][equal[1:] == equal[:-1]]] = True
            up, down = powers(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
            tail = grp[owner] == grp[-1]
            text = mix((sums[start + length] - sums[start]) * down[start] + (shift + 1).astype(np.uint64))
            if seen is not None:
                later |= (grp[owner] == of) & np.isin(text, seen)
            x = np.flatnonzero(later)
            o = owner[x]
            s = at[o] - lo[o] + (start[x] - offsets[:-1][o])
            step = np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)] if len(x) else np.zeros(0, bool)
            f = np.flatnonzero(step)
            z = np.r_[f[1:], len(x)] - 1 if len(x) else f
            return [did[o[f]], th[o[f]], s[f], s[z] + length], text[tail]

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["did", "th", "s", "e"])

        for batch in batches:
            grp = batch.column("grp").to_numpy()
            span = grp == 0
            if span.any():
                own = batch.filter(pa.array(span))
                ends = np.array([int.from_bytes(x, "little") for x in own.column("body").to_pylist()], np.int64)
                yield batch_of([own.column("did").to_numpy(), own.column("th").to_numpy(), own.column("pos").to_numpy(), ends])
                batch, grp = batch.filter(pa.array(~span)), grp[~span]
            if not len(grp):
                continue
            cut = int(np.searchsorted(grp[::-1] != grp[-1], True)) if (grp != grp[-1]).any() else len(grp)
            cut = len(grp) - cut  # where the last, perhaps unfinished, group begins
            if kept and kept[0].column("grp")[0].as_py() != grp[0]:  # the group in hand ended with the last batch
                found, _ = solve(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                yield batch_of(found)
                kept = []
            if cut:
                block = pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
                found, _ = solve(block)
                yield batch_of(found)
                kept = []
            kept.append(batch.slice(cut))
            if of != grp[-1]:
                seen = None
            if sum(map(len, kept)) > most:
                found, own = solve(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                yield batch_of(found)
                seen, of, kept = np.unique(own if seen is None else np.concatenate([seen, own])), int(grp[-1]), []
        if kept:
            found, _ = solve(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
            yield batch_of(found)

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if spans.is_valid and len(spans):
                s, e = (spans.values.field(k).to_numpy() for k in ("s", "e"))
                order = np.argsort(s, kind="stable")
                _, begin, end = _spans(np.zeros(len(s), np.int64), s[order], e[order])
                edges = [0, *(x for pair in zip(begin.tolist(), end.tolist(), strict=True) for x in pair), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(left), len(begin), hashlib.sha256(left).hexdigest(), begin.tolist(), end.tolist()))
            else:
                out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), [], []))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])


def _leads(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for i, j, skip, size in _windows(offsets, length):
                a = offsets[i] + skip
                piece = data[a : a + size]
                got = anchors(piece, np.minimum(np.maximum(offsets[i : j + 1] - a, 0), size), length, gram)
                some = got["at"][got["group"] & np.uint64(15) == np.uint64(0)]
                yield pa.RecordBatch.from_arrays([pa.array(lead(piece, some).view(np.int64))], names=["lead"])

    return rows


def sampled_splitters(docs: DataFrame, buckets: int, length: int, gram: int) -> np.ndarray:
    """Up to buckets - 1 distinct leading tokens that cut a sample of suffixes, from about SAMPLE_TEXTS texts, into equal parts."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)
    sample = docs.where(F.pmod(F.xxhash64("did"), F.lit(1_000_003)) * F.lit(n) < F.lit(1_000_003) * F.lit(SAMPLE_TEXTS)).select("text")
    found = np.sort(np.array([r[0] for r in sample.mapInArrow(_leads(length, gram), "lead long").limit(200_000).collect()], np.int64).view(np.uint64))
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets]) if len(found) else found


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (removed runs, in bytes) of every document."""
    spark = docs.sparkSession
    own = texts(docs)
    repeats = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    # a document's second key: not negative, and among documents of one id their texts' hash; a null id has the least id and a negative second key
    text_hash = F.shiftrightunsigned(F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")), 1) if repeats else F.lit(0).cast("long")
    second = F.when(F.col("doc_id").isNull(), -1 - text_hash).otherwise(text_hash)
    base = own.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("did"), second.alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["did", "th"]
    n = parts(spark)
    splitters = sampled_splitters(base, 64 * n, length, gram)
    suffixes = base.select("did", "th", "text").mapInArrow(_extract(splitters, length, gram), ROWS)
    ranged = suffixes.repartition(n, "bucket").sortWithinPartitions("grp", "tag", "did", "th", "pos").select("grp", "tag", "did", "th", "pos")
    items = ranged.mapInArrow(_first_of_each(length), "did long, th long, grp long, a long, b long").groupBy(*keys).agg(F.collect_list(F.struct("grp", "a", "b")).alias("items"))
    once = base.dropDuplicates(keys) if repeats else base  # rows that repeat a document fetch its bytes once
    fetched = once.join(items, keys, "left").where("items is not null").select("did", "th", "text", "items").mapInArrow(_contexts(splitters, length), CONTEXT)
    again = fetched.repartition(n, "bucket").sortWithinPartitions("grp", "did", "th", "pos").select("grp", "did", "th", "pos", "body")
    spans = again.mapInArrow(_sorted_blocks(length, block), "did long, th long, s long, e long").groupBy(*keys).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    doc_id = F.when(F.col("th") >= 0, F.col("did")).alias("doc_id")
    return base.join(spans, keys, "left").select(doc_id, "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
