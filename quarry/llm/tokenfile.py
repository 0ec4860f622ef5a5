"""op3, token-id output: files of Simple-8b words, read back by vectorised decoding.

A 64-bit word holds a selector in its top four bits and 60 bits of ids, all of one width:
    selector   2   3   4   5   6   7   8   9  10  11  12  13  14  15
    ids       60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits       1   2   3   4   5   6   7   8  10  12  15  20  30  60
Selector 1 is a run of 60 zeros. Selector 0 is the escape: the next word, whole, is one id of more than 60 bits. A word takes as many of
the coming ids as fit; near a block's end, where fewer ids are left than a selector holds, the rest of the word is zero.

File: the magic `QTOKENS1`, then five little-endian 64-bit counts (documents, ids, blocks, words, ids per block), then doc ids (int64,
0 for null), null marks (uint8 padded to 8), ends (int64: ids up to the end of each document), block offsets (int64: words before each block, and their total), and
the words. Each block holds BLOCK ids (the last fewer) and decodes alone. All arrays are whole 64-bit words, so a file can be mapped
and any range of ids read from its blocks alone. Block offsets let the decoder step through all blocks side by side.

The ids of all documents, in ascending doc_id order, are cut into one file for each range of ids: documents are range-partitioned by
doc_id (sampled bounds), encoded and written by the tasks, each file under its final name by a rename, so a repeated task replaces
the same file. The driver sees one row per file (first and last place, counts), sums the counts to each file's start, and a second job
reads the files back.

Edge cases: a null or empty text has the end id alone; a null doc_id comes first; repeated ids keep both rows, in an order that their
texts' hash decides; an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_letters
from quarry.llm.common import gather, parts, shared_dir, texts, token_offsets

MAGIC = b"QTOKENS1"
BLOCK = 256
END_ID = 2
COUNTS = np.array([0, 60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
PIECE = 4 << 20
MEMO = 600_000


def widths(ids: np.ndarray) -> np.ndarray:
    """The narrowest selector width that holds each id; 64 for the escape."""
    steps = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.uint8)
    if len(ids) and ids.max() < 1 << 16:
        if "widths" not in _tables:
            _tables["widths"] = steps[np.searchsorted(np.array([1 << int(b) for b in steps[:-2]], np.uint64), np.arange(1 << 16, dtype=np.uint64), "right")]
        return _tables["widths"][ids]
    return steps[np.searchsorted(np.array([1 << int(b) for b in steps[:-1]], np.uint64), ids, "right")]


_tables: dict[str, np.ndarray] = {}


def pack_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of non-negative ids (below 2^64), and the words before each block, with the total at the end."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // block)
    padded = np.zeros(blocks * block, np.uint64)
    padded[:n] = ids
    width = widths(padded)
    grid = width.reshape(blocks, block)
    left = np.minimum(block, n - np.arange(blocks) * block)
    # widest id among the c ids from each place (places past the block's end need no bits), for the counts that selectors have
    most: dict[int, np.ndarray] = {1: grid}

    def widest(c: int) -> np.ndarray:
        if c not in most:
            half = 1 << (c - 1).bit_length() - 1
            a = widest(half)
            shifted = np.zeros_like(a)
            if c - half < block:
                shifted[:, : block - (c - half)] = a[:, c - half :]
            most[c] = np.maximum(a, shifted)
        return most[c]

    choice = np.zeros((blocks, block), np.uint8)
    for s in range(15, 0, -1):
        choice[widest(int(COUNTS[s])) <= BITS[s]] = s
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        s = choice[live, at[live]]
        steps.append((live, at[live].copy(), s))
        at[live] += np.where(s == 0, 1, COUNTS[s])
        live = live[at[live] < left[live]]
    which = np.concatenate([x[0] for x in steps])
    where = np.concatenate([x[1] for x in steps])
    sel = np.concatenate([x[2] for x in steps])
    order = np.argsort(which * block + where)
    which, where, sel = which[order], where[order], sel[order].astype(np.int64)
    size = np.where(sel == 0, 2, 1)
    before = token_offsets(size)
    words = np.zeros(int(before[-1]), np.uint64)
    place = before[:-1]
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    start = which * block + where
    escape = sel == 0
    words[place[escape] + 1] = padded[start[escape]]
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        room = np.minimum(COUNTS[s], block - where[mine])
        got = words[place[mine]]
        for k in range(int(COUNTS[s])):
            has = k < room
            if not has.any():
                break
            got[has] |= padded[start[mine[has]] + k] << np.uint64(k * int(BITS[s]))
        words[place[mine]] = got
    first = np.searchsorted(which, np.arange(blocks))
    return words, np.append(place[first], before[-1])


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids. The words of all blocks are decoded side by side, one selector at a time."""
    blocks = len(offsets) - 1
    out = np.zeros(blocks * block, np.uint64)
    if not blocks:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():  # an escape's second word is not a selector; escapes may follow one another
        cand = np.flatnonzero(sel == 0)
        for i in cand.tolist():
            if not raw[i] and i + 1 < len(words):
                raw[i + 1] = True
    count = np.where(raw, 0, np.where(sel == 0, 1, COUNTS[sel]))
    before = token_offsets(count)
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    start = before[:-1] - before[offsets[:-1]][owner] + owner * block
    for s in range(2, 16):
        mine = np.flatnonzero((sel == s) & ~raw)
        if not len(mine):
            continue
        room = np.minimum(COUNTS[s], (owner[mine] + 1) * block - start[mine])
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            has = k < room
            if not has.any():
                break
            out[start[mine[has]] + k] = words[mine[has]] >> np.uint64(k * int(BITS[s])) & mask
    escape = np.flatnonzero((sel == 0) & ~raw)
    out[start[escape]] = words[escape + 1]
    return out[:n]


def build_file(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack_words(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets) - 1, len(words), BLOCK], "<i8")
    marks = null.astype(np.uint8).tobytes()
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), marks + b"\0" * (-len(marks) % 8), np.cumsum(lengths).astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def parse_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, null marks, ids per document, ids. Raises ValueError on a file of another kind or a truncated one."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, words, block = np.frombuffer(data, "<i8", 5, 8).tolist()
    at = 48
    if len(data) != at + 16 * docs + (docs + 7) // 8 * 8 + 8 * (blocks + 1 + words):
        raise ValueError("truncated token file")
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    null = np.frombuffer(data, np.uint8, docs, at)
    at += (docs + 7) // 8 * 8
    ends = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    offsets = np.frombuffer(data, "<i8", blocks + 1, at)
    return doc_ids, null.astype(bool), np.diff(ends, prepend=0), unpack_words(np.frombuffer(data, "<u8", words, at + 8 * (blocks + 1)), offsets, n, block)


#: ASCII signs: a run of them is one pretoken.
SIGNS = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class Memo(dict):
    """Chunk -> number. A chunk that it does not know gets the next number and is put down as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class ChunkEncoder:
    """Ids of texts by the tokenizers library. White space never lies within one of this vocabulary's pretokens, so texts are cut at ASCII
    white space and each distinct chunk is encoded once; a bounded memo keeps the chunks met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        said = json.loads(self.tokenizer.to_str())
        self.lower = '"Lowercase"' in json.dumps(said["normalizer"])
        self.END = said["model"].get("end_of_word_suffix")
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.whole = any(x.lstrip or x.rstrip or " " in x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.reset()

    def reset(self) -> None:
        self.code = Memo()
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _plain(self, t: str) -> bool:
        """One pretoken whose normal form is its lower case: letters alone."""
        if not self.END or not t.isalpha():
            return False
        return t.isascii() or ("Σ" not in t and (low := t.lower()).isalpha() and is_normalized("NFC", t) and is_normalized("NFC", low))

    def _ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks one by one. For a chunk of letters alone, or of ASCII signs alone, the normaliser and the pretokeniser have nothing to do
        but the lower case and the letters for bytes, so the library's model takes it as it is."""
        out: list = [None] * len(chunks)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for k, t in enumerate(chunks):
            if not self.END:
                rest.append(k)
            elif t.isascii() and (t.isalpha() or (t.translate(SIGNS) == "" and "<|" not in t)):
                out[k] = [x.id for x in tokenize(t.lower())]
            elif self._plain(t):
                out[k] = [x.id for x in tokenize(t.lower().encode().decode("latin-1").translate(self.letters))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self) -> None:
        """Ids of the chunks that the memo has met for the first time. A chunk is cut before closing punctuation that follows a letter or
        digit: the two are pretokens of their own, and mostly known."""
        code, fresh = self.code, self.code.fresh
        base, lone, mixed, first, second = len(self.sizes), [], [], [], []
        for k, w in enumerate(fresh):  # which grows by the words and endings that are new themselves
            word = w.rstrip(b".,!?;:") if self.END else w
            if 0 < len(word) < len(w) and (word[-1:].isalnum() or (word[-1] > 127 and word.decode().lower()[-1].isalnum())):
                mixed.append(k)
                first.append(code[word])
                second.append(code[w[len(word) :]])
            else:
                lone.append(k)
        got = self._ids([fresh[k].decode() for k in lone])
        size = np.zeros(len(fresh), np.int64)
        size[lone] = np.fromiter(map(len, got), np.int64, len(got))
        pool = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))])
        begin = np.zeros(len(fresh), np.int64)
        begin[lone] = token_offsets(size[lone])[:-1] + len(self.flat)
        begins, sizes = np.concatenate([token_offsets(self.sizes)[:-1], begin]), np.concatenate([self.sizes, size])
        # each fresh chunk is one run of the pool, or two
        runs = np.stack([np.arange(len(fresh)) + base, np.full(len(fresh), -1)], axis=1)
        if mixed:
            runs[mixed] = np.stack([first, second], axis=1)
        n = np.where(runs >= 0, sizes[runs], 0)
        self.flat = np.concatenate([self.flat, pool[gather(begins[runs].ravel(), n.ravel())]])
        self.sizes = np.concatenate([self.sizes, n.sum(axis=1)])
        fresh.clear()

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the ids per text."""
        # the vocabulary is lower-case, so ASCII capitals can go first; not where a special token might arise from them
        split = [[t] if self.whole else (t.lower() if self.lower and b"<|" not in t else t).split() for t in batch]
        if len(self.code) > MEMO:
            self.reset()
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        order = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, int(per_text.sum()))
        if self.code.fresh:
            self._learn()
        if not len(order):
            return np.zeros(0, np.int32), np.zeros(len(batch), np.int64)
        at = token_offsets(self.sizes)
        many = self.sizes[order]
        return self.flat[gather(at[:-1][order], many)], np.diff(token_offsets(many)[token_offsets(per_text)])


_state: dict[str, ChunkEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str) -> ChunkEncoder:
    if path not in _state:
        _state[path] = ChunkEncoder(path)
    return _state[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return np.insert(ids, ends, end), lengths + 1


def open_dir(at: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(at if "://" in at or at.startswith("file:") else f"file://{at}")


def write_token_files(docs: DataFrame, path: str | None = None, end: int = END_ID, files: int | None = None, to: str | None = None) -> DataFrame:
    """Writes the files; one row each: file, part, documents, ids. They lie in folder `to` (by default a new one in the shared folder)."""
    spark = docs.sparkSession
    path = path or default_vocabulary()
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = texts(docs).repartitionByRange(files or parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = _encoder(path), TaskContext.get().partitionId()
        ids, lengths, keys, nulls = [], [], [], []
        for batch in batches:
            column, i = batch.column("text"), 0
            while i < len(column):
                raw, size = [], 0
                while i + len(raw) < len(column) and size < PIECE:
                    x = column[i + len(raw)]
                    raw.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
                    size += len(raw[-1])
                i += len(raw)
                got, n = with_end(*encoder.encode(raw), end)
                ids.append(got.astype(np.uint16 if end < 1 << 16 and (not len(got) or got.max() < 1 << 16) else np.int32))
                lengths.append(n)
            keys.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
        if not keys or not sum(map(len, keys)):
            return
        n = np.concatenate(lengths)
        data = build_file(np.concatenate(keys), np.concatenate(nulls), n, np.concatenate(ids))
        store, folder = open_dir(to)
        store.create_dir(folder, recursive=True)
        name, own = f"{folder}/part-{part:06d}.tok", f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(data)
        store.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{to}/part-{part:06d}.tok"]), pa.array([part], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["file", "part", "documents", "ids"])

    return ordered.mapInArrow(write, "file string, part long, documents long, ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """From rows (file, start): doc_id, start, n_tokens, ids_crc32 of each document, from the file's own bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, name = open_dir(file)
                with store.open_input_file(name) as f:
                    doc_ids, null, lengths, ids = parse_file(f.read())
                at = token_offsets(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = (at * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null), pa.array(at[:-1] + start), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Writes all documents' ids, reads the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    written = sorted(write_token_files(docs, path, end).collect(), key=lambda r: r["part"])  # one short row per file
    start, rows = 0, []
    for r in written:
        rows.append((r["file"], start))
        start += r["ids"]
    files = spark.createDataFrame(rows, "file string, start long")
    return read_token_files(files.repartition(max(1, min(len(rows), parts(spark)))) if rows else files)
