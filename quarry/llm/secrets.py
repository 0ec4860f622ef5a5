"""op9, secret scans: base patterns, and multipart credentials linked by an interval join.

Base matches (leftmost, non-overlapping per kind; spans of the whole match in code points, end exclusive):
  assign  a key word, an equals sign or colon, and a value of 6 or more characters
  access  AKIA and capitals or digits, 20 or more characters in all
  hex     24 or more of 0-9a-f
A match that is too short is dropped after matching, so the characters it took are not looked at again.

The method adds weak candidates: they say nothing alone and are reported only where complementary parts of one credential meet.
  id        an access identifier (base access, or `user|login|client_id|access_key_id` with a value)
  opaque    a run of 32 or more base-64 characters with a digit, a capital and a small letter; it may follow an equals sign directly
  endpoint  scheme://host, or a host under a cloud or internal suffix
Parts become rows (document, scope, start, end). A scope is a run of lines between blank lines; parts of one scope whose intervals
widened by `reach` characters overlap are linked by a join on (document, scope, cell), where a cell is `reach` characters: a weak part is
in the cells that it covers, its partners in those that they cover when widened. So however long a part is no link is lost, and the
join is an equi-join with a residual, never a product of all parts.
A weak part is reported if it links with a part of another kind, one of the two being an identifier or a strong secret.

Edge cases: null and empty texts have no spans; repeated rows are scanned each for itself (an internal row number keeps them apart);
an empty table gives an empty table; other columns are ignored; whole texts are scanned, however long.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import any_names, free_names, pieces, settle, string_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 or more
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
IDENT = re.compile(r"""(?:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,9}://[^\s\"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws\.com|internal|local|corp)\b(?::\d+)?")
BLANK = re.compile(r"\n[ \t\r]*\n")
RANK = {"assign": 0, "access": 1, "hex": 2, "id": 3, "opaque": 4, "endpoint": 5}
_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_LONG = bytes(1 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 0 for b in range(256))
REACH = 400
PIECE = 1 << 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(k.encode() in low for k in KEYS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"\1" * 24 in raw.translate(_RUN):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], RANK[x[0]]))


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """What may be a part of a credential, but is nothing alone."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out = [("id", *m.span()) for m in IDENT.finditer(text)] if any(k in low for k in (b"user", b"login", b"client", b"access")) else []
    if b"\1" * 32 in raw.translate(_LONG):
        out += [("opaque", *m.span()) for m in OPAQUE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    if "://" in text or any(k in low for k in (b".amazonaws", b".internal", b".local", b".corp")):
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


PART = pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("scope", pa.int64())])


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE bytes of text: only so much at a time is made into Python strings."""
    for batch in batches:
        _, offsets = string_bytes(batch.column("text"))
        for i, j in pieces(offsets, PIECE):
            yield batch.slice(i, j - i)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _by_piece(batches):
        counts, digests, lines, parts = [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text) if text else []
            weak = weak_parts(text) if text else []
            kinds = [k for k, _, _ in spans]
            line = _line(spans)
            counts.append([kinds.count("assign"), kinds.count("access"), kinds.count("hex")])
            digests.append(hashlib.sha256(line.encode()).hexdigest())
            lines.append(line)
            rows = []
            if weak:
                cuts = [m.end() for m in BLANK.finditer(text)]
                rows = [{"kind": k, "s": s, "e": e, "scope": bisect_right(cuts, s)} for k, s, e in [*spans, *weak]]
            parts.append(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()), pa.array(lines, pa.string()), pa.array(parts, pa.list_(PART))],
            names=["doc_id", "mark", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"],
        )


def scan_secrets(docs: DataFrame, reach: int = REACH, mark: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: base spans and the weak parts that complement another.

    mark: a long column of docs that is carried along, followed by the base spans alone as column base.
    """
    found = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(mark) if mark else F.lit(0)).cast("long").alias("mark"), F.col("text").cast("string").alias("text"))
        .mapInArrow(_scan, "doc_id long, mark long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<kind:string,s:long,e:long,scope:long>>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    part = found.where(F.size("parts") > 0).select("row", F.inline("parts"))
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor((b - 1) / reach))).alias("cell")
    near = part.select("row", "scope", cells(F.col("s") - reach, F.col("e") + reach), F.col("kind").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"))
    strong = F.col("other").isin("assign", "access", "hex")
    pair = (
        ((F.col("kind") == "id") & (F.col("other").isin("opaque", "endpoint") | F.col("other").isin("assign", "hex")))
        | ((F.col("kind") == "opaque") & (F.col("other").isin("id", "access")))
        | ((F.col("kind") == "endpoint") & (strong | (F.col("other") == "id")))
    )
    apart = (F.col("s") >= F.col("oe")) | (F.col("os") >= F.col("e"))  # a part of the same characters complements nothing
    linked = (
        part.where(F.col("kind").isin("id", "opaque", "endpoint"))
        .select("*", cells(F.col("s"), F.col("e")))
        .join(near, ["row", "scope", "cell"])
        .where(pair & apart & (F.col("s") < F.col("oe") + reach) & (F.col("os") < F.col("e") + reach))
        .groupBy("row", "kind", "s", "e")
        .agg(F.lit(1).alias("one"))
    )
    rank = F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))])
    added = linked.groupBy("row").agg(F.collect_list(F.struct("s", rank[F.col("kind")].alias("rank"), F.concat_ws(":", "kind", "s", "e").alias("span"))).alias("more"))
    own = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("s"), rank[F.split_part(x, F.lit(":"), F.lit(1))].alias("rank"), x.alias("span")))
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(own, "more")), lambda x: x["span"]), ","))
    return found.join(added, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", both.alias("spans"), *([F.col("mark").alias(mark), "base"] if mark else []))


MASK = "[SECRET]"
BROADCAST_ROWS = 50_000


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """Each run of overlapping or touching spans becomes MASK."""
    out, at, end = [], 0, -1
    for s, e in sorted(spans):
        if s > end:
            if end >= 0:
                at = end
            out += [text[at:s], MASK]
            end = e
        end = max(end, e)
    return "".join(out) + text[end if end >= 0 else 0 :]


@any_names
def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All documents with their own columns; every reported span of text is masked, and n_chars, if there, is counted anew.

    Base spans are found again where they are masked; only spans that the linking added travel, by id and a hash of the text.
    """
    own, key, more = free_names(docs.columns, "own_id", "text_hash", "all_spans")
    found = scan_secrets(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), reach, "text_hash").where("spans <> base")
    few = settle(found.select(F.col("doc_id").alias(own), F.col("text_hash").alias(key), F.col("spans").alias(more)).distinct())
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    wide = docs.join(few, docs["doc_id"].cast("long").eqNullSafe(few[own]) & F.xxhash64(docs["text"]).eqNullSafe(few[key]), "left").drop(own, key)
    columns = docs.columns
    at, n_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_piece(batches):
            out = []
            for text, added in zip(batch.column("text").to_pylist(), batch.column(more).to_pylist(), strict=True):
                if text:
                    spans = [(s, e) for _, s, e in base_spans(text)]
                    spans += [tuple(map(int, x.split(":")[1:])) for x in (added or "").split(",") if x]
                    text = mask(text, spans) if spans else text
                out.append(text)
            own = batch.select(columns).set_column(at, "text", pa.array(out, pa.string()))
            if n_at is not None:
                counted = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(batch.schema.field("n_chars").type)
                own = own.set_column(n_at, "n_chars", counted)
            yield own

    return wide.mapInArrow(rows, docs.schema)
