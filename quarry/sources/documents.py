"""Rows from word boxes, cell grids and running text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import joins as J
from quarry.operators.ordering import SUM, numbered, running
from quarry.operators.shared import settle


def synonym_list(spark: SparkSession, path: str) -> DataFrame:
    """Improper, precise: a CSV with semicolons whose second column is a list."""
    raw = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    first, second = raw.columns[:2]
    return raw.select(F.explode(F.split(F.col(f"`{second}`"), ";")).alias("i"), F.col(f"`{first}`").alias("precise")).select(F.trim("i").alias("improper"), "precise").where("improper <> ''")


# The bytes from 128 to 159 as Windows-1252 has them, by its own rule, and those that it leaves undefined.
_HIGH = {bytes([b]).decode("latin-1"): bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)}
_UNDEFINED = "".join(c for c, w in _HIGH.items() if not w)


def read_text(content: Column) -> Column:
    """Bytes as text: UTF-8, else Windows-1252, else (where that leaves a byte undefined) Latin-1; without a byte-order mark."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(c for c, w in _HIGH.items() if w), "".join(_HIGH.values()))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).when(latin.rlike(f"[{_UNDEFINED}]"), latin).otherwise(windows)
    return F.regexp_replace(text, "^\ufeff", "")


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """S3: document, page, text of files named <document>_<page>.txt, S18 for their encodings; Spark passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", r"([^/]+)_(\d+)\.txt$", 1)
    text = read_text(F.col("content"))
    return files.select(name.alias("document"), F.regexp_extract("path", r"_(\d+)\.txt$", 1).cast("int").alias("page"), text.alias("text")).where("document <> ''")


def fill_merged(cells: DataFrame) -> DataFrame:
    """Cells (grid, row, col, text) of merged columns (null) take the text to their left."""
    w = Window.partitionBy("grid", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("text", F.last("text", ignorenulls=True).over(w))


def join_continuations(rows: DataFrame) -> DataFrame:
    """Rows (grid, row, position, code, description) without a code continue the description of the row before; positions carry forward."""
    w = Window.partitionBy("grid").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_i", F.sum(F.when(F.col("code").isNotNull(), 1).otherwise(0)).over(w)).withColumn("position", F.last("position", ignorenulls=True).over(w)).where("_i > 0")
    parts = F.array_sort(F.collect_list(F.struct("row", "description")))
    return marked.groupBy("grid", "_i").agg(F.min("row").alias("row"), F.min_by("position", "row").alias("position"), F.min_by("code", "row").alias("code"), F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x["description"])), lambda x: x != ""), " ").alias("description")).drop("_i")


#: A code as the drawings print it, and the words before a position's number in the small tables on them.
CODE = r"^(\d{7}|\d{5} \d{3} \d{3}[A-Z]?)$"
POSITION_WORDS = ("item", "no", "no.")
LINE_REACH, OVERLAP, INDENT = 2.5, 1.0, 5.0


def codes_on_drawing(words: DataFrame, codes: str = CODE) -> DataFrame:
    """Words (page, x0, y0, x1, y1, word) of drawings -> page, x0, y0, code, position, description for each code with words before it.

    The description: the words that end left of the code on its line (middles less than 2.5 apart), in order, after the last code among them. The
    position: the number of that "Item No <number>" above the code, and not right of it, that is furthest right, then lowest. Words meet
    codes by bands of their page, as many as lines are high.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    words = words.withColumn("ym", middle).withColumn("is_code", F.col("word").rlike(codes))
    wanted = words.where("is_code").select("page", F.col("x0").alias("cx"), F.col("y0").alias("cy"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"), F.col("word").alias("code"), F.col("ym").alias("y"))
    order = F.struct(F.col("x0").alias("x0"), F.round("y0").alias("y"), F.col("word").alias("word"))
    before = words.select("page", "ym", order.alias("w"), F.col("is_code"), F.col("y0").alias("wy0"), F.col("x1").alias("wx1"), F.col("y1").alias("wy1"))
    itself = (F.col("w.x0") == F.col("cx")) & (F.col("wy0") == F.col("cy")) & (F.col("wx1") == F.col("cx1")) & (F.col("wy1") == F.col("cy1")) & (F.col("w.word") == F.col("code"))
    near = J.band_join(wanted, before, ["page"], "y", "ym", LINE_REACH).where((F.abs(F.col("ym") - F.col("y")) < LINE_REACH) & (F.col("wx1") <= F.col("cx") + OVERLAP) & ~itself)
    key = ["page", "cx", "cy", "code"]
    line = near.groupBy(*key).agg(F.max(F.when(F.col("is_code"), F.col("w"))).alias("last"), F.array_sort(F.collect_list(F.when(~F.col("is_code"), F.col("w")))).alias("said"))
    said = F.transform(F.filter("said", lambda w: F.col("last").isNull() | (w > F.col("last"))), lambda w: w["word"])
    found = line.select(*key, F.array_join(said, " ").alias("description")).where("description <> ''")
    # three words that follow each other as a page is read: item, no, a number
    read = Window.partitionBy("page").orderBy(F.round("y0"), "x0", "word")
    heads = words.select("page", F.lag("x0").over(read).alias("hx"), F.lag("y0").over(read).alias("hy"), F.lag("word").over(read).alias("first"), F.lower("word").alias("second"), F.lead("word").over(read).alias("position"))
    heads = heads.where((F.lower("first") == POSITION_WORDS[0]) & F.col("second").isin(*POSITION_WORDS[1:]) & F.col("position").rlike(r"^\d+$"))
    above = found.join(heads.select("page", "hx", "hy", "position"), "page").where((F.col("hy") < F.col("cy")) & (F.col("hx") <= F.col("cx") + INDENT))
    nearest = above.groupBy(*key).agg(F.max_by("position", F.struct("hx", "hy", "position")).alias("position"))
    return found.join(nearest, key, "left").select("page", F.col("cx").alias("x0"), F.col("cy").alias("y0"), "code", "position", "description")


def ocr_rows(anchors: DataFrame, words: DataFrame, reach: float = 20.0) -> DataFrame:
    """For each anchor (page, position, y) its words (page, word, wx, wy, x1, y1, confidence) in a band, in order of x, with mean confidence and box."""
    # positions of the same heights have the same words: these are gathered once for all of them
    placed = anchors.groupBy("page", "position").agg(F.array_sort(F.collect_list("y")).alias("_ys"))
    heights = placed.select("page", "_ys").distinct().select("page", "_ys", F.explode("_ys").alias("y"))
    pairs = J.band_join(heights, words, ["page"], "y", "wy", reach)
    said = F.array_sort(F.collect_list(F.struct("wx", "word")))
    lines = pairs.groupBy("page", "_ys").agg(F.array_join(F.transform(said, lambda s: s["word"]), " ").alias("description"), F.avg("confidence").alias("confidence"), F.min("wx").alias("x0"), F.min("wy").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return placed.join(lines, ["page", "_ys"]).drop("_ys")


# What a drawing's page says besides its title.
NO_PAGE_TITLE = r"(?i)www\.|\bdoc\b|\brev\b|series|part no|descri|^model name$|item no"


def is_code(c: Column) -> Column:
    """whether a text is a code as the catalogs print them."""
    return F.coalesce(c.rlike(CODE), F.lit(False))


def page_titles(texts: DataFrame) -> DataFrame:
    """page, title of pages' texts (page, text): the first line of more than six characters, with three letters on end, that is not of the head of every page
    and not of digits alone; pages without one give no row."""
    lines = texts.select("page", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    good = lines.where((F.length("line") > 6) & F.col("line").rlike("[A-Za-z]{3}") & ~F.col("line").rlike(NO_PAGE_TITLE) & ~F.col("line").rlike(r"^[\d\s]+$"))
    return good.groupBy("page").agg(F.min_by("line", "at").alias("title"))


# Fixed values of the manuals' headings: with a number, or in capitals (two to ten words, 8 to 80 characters, not the maker's name).
_CAPITAL = "A-ZÀÈÉÌÒÙ"
NUMBERED = rf"^\s*(\d{{1,2}}(?:\.\d{{1,2}})?)\s*[.)]?\s+([{_CAPITAL}][{_CAPITAL}'’ /\-]{{3,}}[{_CAPITAL}])\s*$"
CAPITALS = rf"^\s*([{_CAPITAL}][{_CAPITAL}'’]+(?: [{_CAPITAL}'’/\-]+){{1,9}})\s*$"
NO_TITLE, MEAN_LETTERS, SHORTEST, LONGEST = "LANCER", 3.5, 8, 80
BEGINNING = "(inizio)"
#: Lines of a section that one task folds at a time.
CHUNK = 4096


def manual_lines(texts: DataFrame) -> DataFrame:
    """manual, page, at, line of pages' texts (manual, page, text): words parted at a line's end are joined, blanks and empty lines reduced."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\r\n|\r|\n")
    return texts.select("manual", "page", F.posexplode(F.when(F.trim("text") != "", lines)).alias("at", "line"))


def heading_of(line: Column) -> Column:
    """{number, title} of a line that is a heading, else null."""
    number, titled = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, NUMBERED, 2)
    capital = F.regexp_extract(line, CAPITALS, 1)
    words = F.split(capital, " ")
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words)
    loud = (capital != "") & F.length(capital).between(SHORTEST, LONGEST) & ~capital.contains(NO_TITLE) & (mean >= MEAN_LETTERS)
    return F.when(titled != "", F.struct(number.alias("number"), titled.alias("title"))).when(loud, F.struct(F.lit(None).cast("string").alias("number"), capital.alias("title")))


def _triggers(lengths: np.ndarray, blank: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of paragraphs in a run of lines; characters up to each; where the next cut is if one is there; and what is left after the last."""
    total = np.cumsum(lengths)
    ends = np.flatnonzero(blank)
    upto = total[ends]
    following = np.searchsorted(upto, upto + limit, "right")  # the first end with more than limit characters since this one
    return ends, upto, following, total


def _fold_summary(limit: float):
    """For a run of lines: `least` characters before it that make its k-th end of a paragraph the first cut, and then its cuts and what is left; and all its characters."""

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        lengths, blank = rows.column("size").to_numpy().astype(np.int64), rows.column("blank").to_numpy(zero_copy_only=False).astype(bool)
        ends, upto, following, total = _triggers(lengths, blank, limit)
        cuts, left = np.ones(len(ends) + 1, np.int64), np.zeros(len(ends) + 1, np.int64)
        cuts[-1] = 0
        for i in range(len(ends) - 1, -1, -1):
            n = following[i]
            cuts[i] = 1 + (cuts[n] if n < len(ends) else 0)
            left[i] = left[n] if n < len(ends) else total[-1] - upto[i]
        new = np.flatnonzero(np.diff(upto, prepend=-1) > 0)  # the others can't be the first cut
        new = new[: int(np.searchsorted(upto[new], limit, "right")) + 1]
        head = rows.slice(0, 1).select(["manual", "section", "chunk"])
        lists = {"upto": upto[new], "cuts": cuts[new], "left": left[new]}
        for name, values in lists.items():
            head = head.append_column(name, pa.array([values.tolist()], pa.list_(pa.int64())))
        return head.append_column("total", pa.array([int(total[-1])], pa.int64()))

    return fold


def _carried(limit: float):
    """Streams the summaries of sections in order: the characters since the last cut, and the cuts, before each run of lines."""

    def walk(batches):
        at, before, blocks = None, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (row["manual"], row["section"]):
                    at, before, blocks = (row["manual"], row["section"]), 0, 0
                out.append((before, blocks))
                k = next((k for k, u in enumerate(row["upto"]) if before + u > limit), None)
                before, blocks = (before + row["total"], blocks) if k is None else (row["left"][k], blocks + row["cuts"][k])
            keys = [batch.column(c) for c in ("manual", "section", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["manual", "section", "chunk", "before", "blocks"])

    return walk


def _cut(limit: float):
    """The block of each line of a run, from what came before it."""

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        lengths, blank = rows.column("size").to_numpy().astype(np.int64), rows.column("blank").to_numpy(zero_copy_only=False).astype(bool)
        ends, upto, following, _ = _triggers(lengths, blank, limit)
        first = np.flatnonzero(upto + rows.column("before")[0].as_py() > limit)
        ended, k = np.zeros(len(lengths) + 1, np.int64), int(first[0]) if len(first) else len(ends)
        while k < len(ends):
            ended[ends[k] + 1] = 1  # a block's last line is the empty one that ends it
            k = int(following[k])
        block = rows.column("blocks")[0].as_py() + np.cumsum(ended)[:-1]
        return rows.select(["manual", "section", "place"]).append_column("block", pa.array(block, pa.int64()))

    return cut


def sections(lines: DataFrame, most: int = 2500, least: int = 40, chunk: int = 0) -> DataFrame:
    """Lines (manual, page, at, line) -> manual, section, part, number, title, first_page, last_page, body. A heading begins a section; a section is cut
    at the first empty line after 0.8 * most characters since its last cut; blocks under `least` characters go.

    A cut depends on the one before it. Sections go in runs of CHUNK lines: each run says, for what may come before it, where its first cut is and what
    it leaves; these summaries, one row a run, are walked in order, streaming; then each run knows its cuts. Only lengths travel, no run is longer than
    CHUNK lines, and no window or sort is over one section or manual. The lines before the first heading are a section of the title "(inizio)".
    """
    limit = 0.8 * most
    size = chunk or CHUNK
    kind = lines.schema["manual"].dataType.simpleString()
    placed = numbered(lines.select("manual", "page", "at", F.coalesce("line", F.lit("")).alias("line")), ["manual"], "page", "at")
    placed = placed.withColumn("head", heading_of(F.col("line"))).withColumn("section", F.col("head").isNotNull().cast("long"))
    placed = settle(running(placed, ["manual"], "place", {"section": SUM}))
    heads = placed.where("head is not null").select("manual", "section", "head.number", F.concat(F.upper(F.left(F.trim("head.title"), F.lit(1))), F.lower(F.substring(F.trim("head.title"), 2, 1 << 20))).alias("title"))
    own = placed.where("head is null").withColumn("blank", F.trim(F.regexp_replace("line", r"\s", "")) == "").withColumn("size", F.when(F.col("blank"), 0).otherwise(F.length("line")).cast("long"))
    runs = own.select("manual", "section", F.floor(F.col("place") / size).alias("chunk"), "place", "size", "blank")
    run = ["manual", "section", "chunk"]
    keys = f"manual {kind}, section long, chunk long"
    summaries = runs.groupBy(*run).applyInArrow(_fold_summary(limit), f"{keys}, upto array<long>, cuts array<long>, left array<long>, total long")
    walked = summaries.repartition("manual", "section").sortWithinPartitions(*run).mapInArrow(_carried(limit), f"{keys}, before long, blocks long")
    cut = runs.join(walked, run).groupBy(*run).applyInArrow(_cut(limit), f"manual {kind}, section long, place long, block long")
    texts = own.join(cut, ["manual", "section", "place"])
    block = ["manual", "section", "block"]
    first = texts.where("not blank").groupBy(*block).agg(F.min("place").alias("first"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("blank"), "").otherwise(F.col("line")).alias("line")))), lambda x: x["line"]), "\n")
    bodies = texts.join(first, block).where("place >= first").groupBy(*block).agg(F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"), F.first("first_page").alias("first_page"), F.first("last_page").alias("last_page"))
    kept = bodies.where(F.length("body") >= least).join(heads, ["manual", "section"], "left")
    part = F.row_number().over(Window.partitionBy("manual", "section").orderBy("block")) - 1
    return kept.select("manual", "section", part.cast("long").alias("part"), "number", F.coalesce("title", F.lit(BEGINNING)).alias("title"), "first_page", "last_page", "body")
