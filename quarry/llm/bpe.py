"""op2, BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1. Pretokens ("words") of all texts are counted on the executors; the most frequent LEXICON_WORDS (a parameter that bounds the
   lexicon's size, not the result) become the lexicon.
2. The lexicon is compiled into a minimal acyclic automaton with shared suffixes. Each arc carries the number of words that sort before
   what it leads to, so the sum along a path is the word's rank, and the rank finds the word's token ids in one flat array: the outputs.
3. The arrays are one bounded file, which Spark ships once to each executor; its Python workers memory-map it and share the pages.
4. Each batch looks the words up that its task has not met, all words at once, one byte a step. Words that the automaton does not hold are merged
   exactly, all at once too: in each round every word merges the occurrences of its lowest-ranked pair, left to right.
5. Decoding goes from ids back to bytes by the vocabulary's byte strings, then to text with replacement of invalid sequences.

The vocabulary file is a parameter (a byte-level BPE in the tokenizers library's JSON form, with no normaliser) and is never trained.
Added tokens of the file are matched in the text before anything else, as the library does.

Edge cases: a null text counts as empty: no ids, and the digests of the empty string; repeated rows are encoded each for itself; very
long texts are encoded whole, in pieces of words; an empty table gives an empty table (the lexicon is then empty too); extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import gather, pieces, settle, shared_dir, string_bytes, texts, token_offsets

#: Fixed value: the pretokeniser of byte-level BPE, with white space spelled as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LEXICON_WORDS = 1 << 16
PIECE = 1 << 20
#: Distinct chunks, and characters read, after which a task hands on the pretokens counted so far: they bound its memory, not the result.
CHUNKS = 75_000
CHARACTERS = 1 << 25
#: Distinct chunks whose ids an encoding task keeps from piece to piece: they bound its memory, not the result.
KEPT = 1 << 17
#: White space that cuts joined chunks: it is a pretoken of its own before a blank or any other character.
MARK = "\u2028"
EMPTY = np.uint32(0xFFFFFFFF)
_state: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, byte strings and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        vocab, letters = model["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.added = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        size = max([*vocab.values(), *self.added.values()]) + 1
        strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            strings[i] = token.encode()
        self.strings = strings
        self.lengths = np.fromiter(map(len, strings), np.int64, size)
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.begins = token_offsets(self.lengths)[:-1]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if size > 65536:
            raise ValueError("ids of more than 16 bits")
        key = (left << 16 | right).astype(np.uint32)
        bits = max(4, (4 * len(key) - 1).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.uint32)
        self.ranks = np.zeros(1 << bits, np.int32)
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slots(key).tolist(), strict=True)):
            while self.keys[slot] != EMPTY:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.ranks[slot] = k, rank
        tokens = [regex.escape(t) for t in sorted(self.added, key=len, reverse=True)]
        self.split = regex.compile("(" + "|".join(tokens) + ")") if tokens else None
        self.find = regex.compile(WORDS).findall

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; 2^30 where there is none."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self._slots(key)
        got = self.keys[slot]
        out = np.where(got == key, self.ranks[slot], np.int32(1 << 30))
        todo = np.flatnonzero((got != key) & (got != EMPTY))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & self.mask
            got = self.keys[slot]
            hit = got == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (got != EMPTY)
            todo, slot = todo[more], slot[more]
        return out

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes end to end (no word is empty), and how many each word has."""
        n = len(lengths)
        symbols = self.byte_id[data]
        word = np.repeat(np.arange(n), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), 1 << 30, np.int32)
            if len(symbols) > 1:
                same = word[1:] == word[:-1]
                at = np.flatnonzero(same)
                rank[at] = self.rank(symbols[at], symbols[at + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            low = np.minimum.reduceat(rank, first)
            over = np.repeat(low == 1 << 30, size)
            if over.any():
                done.append((word[over], symbols[over]))
                go = ~over
                symbols, word, rank = symbols[go], word[go], rank[go]
                size, low = size[low != 1 << 30], low[low != 1 << 30]
                if not len(symbols):
                    break
            hit = rank == np.repeat(low, size)
            # in a run of overlapping hits (one symbol repeated) every other one merges, from the left
            i = np.flatnonzero(hit)
            fresh = np.r_[True, (i[1:] != i[:-1] + 1) | (word[i[1:]] != word[i[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - run) % 2 == 0]
            symbols = symbols.copy()
            symbols[i] = self.merged[rank[i]]
            keep = np.ones(len(symbols), bool)
            keep[i + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=n)

    def words(self, text: str) -> list[str]:
        """Pretokens of a text; an added token of the file is a word of its own."""
        if self.split is None or not any(t in text for t in self.added):
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self.find(part)
        return out

    def split_all(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Pretokens of many chunks, none of which ends in white space or holds an added token or MARK; and how many each has."""
        found = self.find(MARK.join(chunks)) if chunks else []
        ends = np.flatnonzero(np.fromiter(map(MARK.__eq__, found), bool, len(found)))
        sizes = np.diff(np.r_[-1, ends, len(found)]) - 1
        return [w for w in found if w != MARK], sizes[: len(chunks)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids end to end, and the length of each."""
        n = self.lengths[ids]
        return self.flat[gather(self.begins[ids], n)], n


def vocabulary(path: str) -> Vocabulary:
    if path not in _state:
        _state[path] = Vocabulary(path)
    return _state[path]


def compile_lexicon(words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """A minimal acyclic automaton of sorted distinct words, with ids (flat) of `lengths` each as outputs.

    arcs: keys (state * 256 + byte), sorted; to: target; skip: words that sort before those through the arc, within its state.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    below: list[int] = []  # words in each state's right language

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        found = register.get(key)
        if found is None:
            found = register[key] = len(finals)
            finals.append(node[0])
            arcs.append(key[1])
            below.append(node[0] + sum(below[t] for _, t in key[1]))
        return found

    path: list[list] = [[False, []]]  # unfrozen states along the last word: final, arcs so far
    last = b""
    for w in words:
        common = 0
        while common < min(len(last), len(w)) and last[common] == w[common]:
            common += 1
        for k in range(len(last), common, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[k - 1], state))
        for _ in w[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    for k in range(len(last), 0, -1):
        state = freeze(path.pop())
        path[-1][1].append((last[k - 1], state))
    root = freeze(path.pop())
    key, to, skip = [], [], []
    for s, out in enumerate(arcs):
        before = int(finals[s])
        for byte, t in out:
            key.append(s << 8 | byte)
            to.append(t)
            skip.append(before)
            before += below[t]
    return {
        "keys": np.array([*key, 1 << 40], np.int64), "to": np.array([*to, 0], np.int32), "skip": np.array([*skip, 0], np.int32), "final": np.array(finals, bool),
        "root": np.array([root], np.int32), "at": token_offsets(lengths), "ids": ids.astype(np.int32),
    }


class Lexicon:
    """The automaton of compile_lexicon, looked up for many words at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    def ranks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rank of each word among the lexicon's, or -1."""
        n = len(starts)
        out = np.full(n, -1, np.int64)
        live, state, rank, k = np.arange(n), np.full(n, self.root[0], np.int64), np.zeros(n, np.int64), 0
        while len(live):
            ended = lengths[live] == k
            if ended.any():
                e = np.flatnonzero(ended)
                good = self.final[state[e]]
                out[live[e[good]]] = rank[e[good]]
                go = ~ended
                live, state, rank = live[go], state[go], rank[go]
            want = state << 8 | data[starts[live] + k]
            arc = np.searchsorted(self.keys, want)
            found = self.keys[arc] == want
            live, arc, rank = live[found], arc[found], rank[found]
            state, rank = self.to[arc].astype(np.int64), rank + self.skip[arc]
            k += 1
        return out


class Packed:
    """Where the executors find the lexicon: one file, which Spark ships once to each of them, and what lies where in it."""

    def __init__(self, spark: SparkSession, arrays: dict[str, np.ndarray]):
        self.name, self.layout, at = f"lexicon-{uuid.uuid4().hex}", {}, 0
        out = bytearray()
        for k, x in arrays.items():
            self.layout[k] = (x.dtype.str, len(x), at)
            out += x.tobytes() + bytes(-x.nbytes % 8)
            at = len(out)
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{self.name}")
        stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        stream.write(out)
        stream.close()
        sc.addFile(path.toString())

    def lexicon(self) -> Lexicon:
        """The memory-mapped lexicon; all workers of an executor share its pages."""
        if _state.get("lexicon_of") != self.name:
            whole = np.memmap(SparkFiles.get(self.name), np.uint8, "r")
            _state["lexicon"] = Lexicon({k: whole[at : at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in self.layout.items()})
            _state["lexicon_of"] = self.name
        return _state["lexicon"]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """Runs of texts of about PIECE bytes: only one run at a time is made into Python strings."""
    _, offsets = string_bytes(column)
    for i, j in pieces(offsets, PIECE):
        yield i, j, column[i:j].to_pylist()


def count_words(docs: DataFrame, path: str, most: int) -> DataFrame:
    """The frequent pretokens of all texts, at most `most`, all those above one count: word, n. A word that occurs once is never frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, whole, firsts = vocabulary(path), Counter(), Counter()

        def out() -> pa.RecordBatch:
            found: dict[str, int] = {}
            for chunks, lead in ((whole, " "), (firsts, "")):
                joined = "\n".join(chunks)
                special = [a for a in vocab.added if a in joined]
                plain = [w for w in chunks if w and w.strip() == w and MARK not in w and not (special and any(a in w for a in special))]
                tokens, sizes = vocab.split_all([lead + w for w in plain])
                for w, n in zip(tokens, np.repeat(np.fromiter(map(chunks.__getitem__, plain), np.int64, len(plain)), sizes).tolist(), strict=True):
                    found[w] = found.get(w, 0) + n
                for w in chunks.keys() - set(plain):
                    for x in vocab.words(lead + w):
                        found[x] = found.get(x, 0) + chunks[w]
                chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        read = 0
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                first, *rest = text.split(" ")
                whole.update(rest)
                firsts[first] += 1
                read += len(text)
                if len(whole) + len(firsts) > CHUNKS or read > CHARACTERS:
                    yield out()
                    read = 0
        yield out()

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counted = settle(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # the cut is found on a log scale of counts, so that no task sends more than it must
    level = F.floor(F.log2(F.col("n")) * 64).cast("int")
    levels = sorted(((r["level"], r["words"]) for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    low, total = None, 0
    for at, n in levels:
        if total + n > most:
            break
        low, total = at, total + n
    return counted.where(level >= low) if low is not None else counted.limit(0)


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> dict[str, np.ndarray]:
    """Counts on the executors; the driver compiles at most `most` words."""
    vocab = vocabulary(path)
    words = sorted(r["word"].encode() for r in count_words(docs, path, most).collect() if r["word"] not in vocab.added)
    data = np.frombuffer(b"".join(words), np.uint8)
    ids, n = vocab.merge(data, np.fromiter(map(len, words), np.int64, len(words)))
    return compile_lexicon(words, ids, n)


def encode_words(vocab: Vocabulary, lexicon: Lexicon, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words end to end, and how many each has."""
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = token_offsets(lengths)[:-1]
    rank = lexicon.ranks(data, starts, lengths)
    special = np.fromiter((vocab.added.get(w, -1) for w in words), np.int64, len(words)) if any(w in vocab.added for w in words) else None
    if special is not None:
        rank[special >= 0] = -1
    known = rank >= 0
    n = np.zeros(len(words), np.int64)
    n[known] = lexicon.at[rank[known] + 1] - lexicon.at[rank[known]]
    rest = np.flatnonzero(~known)
    own, many = vocab.merge(data[gather(starts[rest], lengths[rest])], lengths[rest])
    if special is not None:
        keep = np.repeat(special[rest] < 0, many)
        at = np.flatnonzero(special[rest] >= 0)
        first = token_offsets(np.where(special[rest] >= 0, 0, many))[at]
        own = np.insert(own[keep], first, special[rest][at].astype(np.int32))
        many[at] = 1
    n[rest] = many
    out = np.zeros(int(n.sum()), np.int32)
    begins = token_offsets(n)[:-1]
    out[gather(begins[known], n[known])] = lexicon.ids[gather(lexicon.at[rank[known]], n[known])]
    out[gather(begins[rest], many)] = own
    return out, n


class Chunks:
    """The chunks of text that a task has read, and their ids: each is made once for all its pieces, until there are more than KEPT of them."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.firsts: dict[str, int] = {}  # chunks that begin a text, and those after a blank, by their place below
        self.others: dict[str, int] = {}
        self.odd: set[str] = set()
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.lines: list[str] = []


def encode(vocab: Vocabulary, lexicon: Lexicon, column: pa.Array, kept: Chunks | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """Runs [i, j) of texts with their ids end to end, tokens per text, and each text's ids as decimals joined by commas."""
    kept = kept or Chunks()
    for i, j, batch in _pieces(column):
        # A blank between two characters that are not white space is always the start of a pretoken, so texts are cut there and each
        # distinct chunk is split into pretokens once. Texts with other white space next to a blank are split as a whole.
        special = [a for a in vocab.added if any(a in t for t in batch if t)]
        split = [t.split(" ") if t else [] for t in batch]
        n_kept = len(kept.lines)
        firsts = [w for w in dict.fromkeys(x[0] for x in split if x) if w not in kept.firsts]
        others = list(set().union(*split).difference(kept.others))
        kept.firsts.update(zip(firsts, range(n_kept, n_kept + len(firsts)), strict=True))
        kept.others.update(zip(others, range(n_kept + len(firsts), n_kept + len(firsts) + len(others)), strict=True))
        odd, index, begins = kept.odd, kept.others, kept.firsts
        odd.update(w for w in others if not w or w.strip() != w or MARK in w)
        if special:
            odd.update(w for w in others if any(a in w for a in special))
        tokens, sizes = vocab.split_all([w if w not in odd else "-" for w in firsts] + [" " + w if w not in odd else "-" for w in others])
        n_chunks = n_kept + len(sizes)
        codes: list[list[int]] = []
        whole: list[list[str]] = []
        for x, text in zip(split, batch, strict=True):
            if x and odd and not odd.isdisjoint(x):
                codes.append([n_chunks + len(whole)])
                whole.append(vocab.words(text))
            elif x:
                code = list(map(index.__getitem__, x))
                code[0] = begins[x[0]]
                codes.append(code)
            else:
                codes.append([])
        if whole:
            tokens += chain.from_iterable(whole)
            sizes = np.r_[sizes, np.fromiter(map(len, whole), np.int64, len(whole))]
        words = dict.fromkeys(tokens)
        for k, w in enumerate(words):
            words[w] = k
        flat, n = encode_words(vocab, lexicon, list(words))
        at = token_offsets(n)
        order = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        flat = flat[gather(at[:-1][order], n[order])]  # ids of the new chunks
        at = token_offsets(n[order])[token_offsets(sizes)]
        said = list(map(str, flat.tolist()))
        bounds = at.tolist()
        kept.lines += [",".join(said[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        lines = [",".join(map(kept.lines.__getitem__, c)) for c in codes]
        flat, at = np.concatenate([kept.flat, flat]), np.concatenate([kept.at, kept.at[-1] + at[1:]])
        per_text = np.fromiter(map(len, codes), np.int64, len(codes))
        order = np.fromiter(chain.from_iterable(codes), np.int64, int(per_text.sum()))
        many = np.diff(at)[order]
        yield i, j, flat[gather(at[:-1][order], many)], np.diff(token_offsets(many)[token_offsets(per_text)]), lines
        if n_chunks > KEPT:
            kept.clear()
        else:  # texts that were split as a whole are not kept
            kept.flat, kept.at = flat[: at[n_chunks]], at[: n_chunks + 1]
            del kept.lines[n_chunks:]


def encode_documents(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path = path or default_vocabulary()
    packed = Packed(docs.sparkSession, build_lexicon(docs, path, words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon, kept = vocabulary(path), packed.lexicon(), Chunks()
        for batch in batches:
            for i, j, ids, per_text, lines in encode(vocab, lexicon, batch.column("text"), kept):
                raw, n = vocab.decode(ids)
                ends = token_offsets(n)[token_offsets(per_text)].tolist()
                whole = raw.tobytes()
                digests = [hashlib.sha256(whole[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(per_text), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]), pa.array(digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_documents(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """The ids themselves, and the decoded text: doc_id, ids (array), decoded."""
    path = path or default_vocabulary()
    packed = Packed(docs.sparkSession, build_lexicon(docs, path, words))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lexicon, kept = vocabulary(path), packed.lexicon(), Chunks()
        for batch in batches:
            for i, j, ids, per_text, _ in encode(vocab, lexicon, batch.column("text"), kept):
                raw, n = vocab.decode(ids)
                at = token_offsets(per_text)
                ends, whole = token_offsets(n)[at].tolist(), raw.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)])], names=["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(rows, "doc_id long, ids array<int>, decoded string")
