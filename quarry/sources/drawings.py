"""Drawings in the new format, from the nodes of their pages (page_id, url, html).

A page may hold several drawings. A drawing is an outermost table that says GR TAV, or else the whole body; its number is the first of: a heading,
paragraph or cell that is nothing but a number, the page's first named anchor, the page's remark, the file's name. Without a number,
or without rows, there is no drawing. Inside it, tables of parts are those whose heading cells say so or that link to a code; each of their rows
belongs to the innermost table around it and has the cells that are directly its own.

A page is read, walked over once and let go where it is (`_Page`): what is inside an element is a run of places, the innermost row or table around one the last that is open.
Rows without a part are read in order as notes and validity: a validity row may carry its serial number, or the next row of a serial number
carries it; a note without text of its own takes the next row that says nothing else. Windows are over one drawing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from quarry.sources import nodes as N
from quarry.sources.portals import NOTE, NOTE_MARK, SERIAL, VALID_SINCE, VALID_UNTIL

# Fixed values of the new drawing format.
DRAWING_ID = r"\d{2}(?:_[0-9A-Z]{1,3})+"
ANY_ID = rf"\b({DRAWING_ID})\b"
REMARK_ID = rf"(?i)TAVOLA\s+({DRAWING_ID})"
POSITION = r"^\s*\d+[\w\-*/.]*\s*$"
CODE = r'(?i)CODICE=([^&"\s]+)'
DATE = r"\b(\d{2}\.\d{4})\b"
MODELS = r"^[\w\s./+-]*\d[\w\s./+-]*$"
TITLE_CELL = r"(?i)TESTINA[^>]*-->\s*([^<]+)"
BLOCK_MARK, GROUP_LINK, IMAGE = "GR TAV", "grup", "tav"


def one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def file_of(url: Column) -> Column:
    """The last piece of a url's path."""
    return F.substring_index(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z+.-]*://[^/?#]*|[?#].*$", ""), "/", -1)


def absolute(base: Column, link: Column) -> Column:
    """A link as its page's url makes it absolute; steps up (../) are taken."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z+.-]*://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"^[a-zA-Z][a-zA-Z+.-]*://[^/?#]*|[?#].*$", ""), r"[^/]*$", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z+.-]*:)", 1)
    joined = F.split(F.concat(F.when(F.startswith(link, F.lit("/")), F.lit("")).otherwise(path), link), "/")
    piece = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    walked = F.aggregate(joined, F.array().cast("array<string>"), piece)
    plain = F.concat(root, F.when(F.startswith(F.array_join(walked, "/"), F.lit("/")), F.lit("")).otherwise(F.lit("/")), F.array_join(walked, "/"))
    own = F.coalesce(link, F.lit(""))
    return F.when(own == "", base).when(own.rlike(r"^[a-zA-Z][a-zA-Z+.-]*:"), own).when(F.startswith(own, F.lit("//")), F.concat(scheme, own)).otherwise(plain)


def group_drawings(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, place, drawing, label, title, url of a group's index: the links of its kind, each url once. Nodes must have their paths."""
    links = N.of_page(lambda x: N.is_tag("a", of=x) & N.has_class(GROUP_LINK, of=x) & N.has_attr("href", of=x))
    said = lambda x: F.struct(x["enter"].alias("a"), N.attr("href", of=x).alias("href"), N.text_of(x).alias("label"), N.innermost(x, "tr").alias("tr"))
    title = lambda tr: N.text_of(F.try_element_at(N.inside(F.get("nodes", tr), lambda n: N.is_tag("td", of=n)), F.lit(-1)))
    titles = lambda found: N.let(F.array_distinct(F.filter(F.transform(found, lambda x: x["tr"]), lambda tr: tr.isNotNull())), lambda trs: F.map_from_arrays(trs, F.transform(trs, title)))
    titled = lambda found: N.let(titles(found), lambda t: F.transform(found, lambda x: x.withField("title", F.try_element_at(t, x["tr"]))))  # noqa: E731  a row's title is made once for all its links
    found = N.with_url(nodes, pages).select("page_id", "url", F.inline(N.let(F.transform(links, said), titled)))
    found = found.withColumn("url", F.substring_index(absolute(F.col("url"), F.col("href")), "#", 1))
    named = F.coalesce(F.nullif(F.regexp_extract(file_of(F.col("url")), ANY_ID, 1), F.lit("")), F.col("label"))
    rows = N.first(found, ["page_id", "url"], "a", "label", "title")
    return rows.select("page_id", F.col("a").alias("place"), named.alias("drawing"), "label", F.coalesce("title", F.lit("")).alias("title"), "url")


KEY = ["page_id", "block", "drawing"]


ENDING = r"(?:\r\n|[\n\r\x85\u2028\u2029])?\Z"  # where the patterns' $ stands
is_number = re.compile(DRAWING_ID + ENDING, re.ASCII).match
is_number_alone = re.compile(rf"\s*{DRAWING_ID}\s*{ENDING}", re.ASCII).match
is_code_link = re.compile(CODE, re.ASCII).search
one_space = partial(re.compile("[ \t\n\x0b\f\r\xa0]+").sub, " ")
TEXT, BODY, TABLE, ROW, CELL, HEADING_CELL, LINE, PICTURE, LINK = range(1, 10)
ROLES = {N.TEXT: TEXT, "body": BODY, "table": TABLE, "tr": ROW, "td": CELL, "th": HEADING_CELL, "h2": LINE, "h3": LINE, "p": LINE, "img": PICTURE, "a": LINK}


class _Page:
    """What a page's drawings are made of, gathered in one walk over its nodes, with the innermost table and row around each."""

    def __init__(self, reader, html: str):
        self.reader = reader
        self.said, self.leave, texts = reader.page(html)
        kinds, leave, leaves = reader.kinds, self.leave, iter(texts)
        self.places, self.texts = [], []  # of the texts that are not blank
        self.body, self.name = None, None
        self.tables, self.outer, self.headings, self.lines, self.pictures = [], [], [], [], []
        self.rows, self.cells, self.links, self.coded = {}, {}, {}, set()  # rows of a table, cells and first link to a code of a row, tables of such links
        self.numbers = []  # places of elements around each text that says nothing but a number
        tables, rows, around = [], [], []
        for at, kind in enumerate(self.said):
            tag = kinds[kind][0]
            role = ROLES.get(tag)
            if role == TEXT or kind < len(N.LEAVES):
                text = next(leaves)
                if role == TEXT:
                    plain = one_space(text).strip(" ")
                    if plain:
                        self.places.append(at)
                        self.texts.append(plain)
                    if is_number_alone(text):
                        self.numbers.append((at, [x for x in around if leave[x] >= at]))
                continue
            if role is None:
                continue
            if role == TABLE:
                while tables and leave[tables[-1]] < at:
                    tables.pop()
                if not tables:
                    self.outer.append(at)
                self.tables.append(at)
                tables.append(at)
            elif role == ROW:
                while tables and leave[tables[-1]] < at:
                    tables.pop()
                rows.append(at)
                if tables:
                    self.rows.setdefault(tables[-1], []).append(at)
            elif role == CELL or role == LINE:
                while around and leave[around[-1]] < at:
                    around.pop()
                around.append(at)
                if role == LINE:
                    self.lines.append(at)
                    continue
                while rows and leave[rows[-1]] < at:
                    rows.pop()
                if rows:
                    self.cells.setdefault(rows[-1], []).append(at)
            elif role == LINK:
                attrs = dict(reader.lists["attrs"][kinds[kind][2]])
                if self.name is None:
                    self.name = attrs.get("name")
                if is_code_link(attrs.get("href", "")):
                    while tables and leave[tables[-1]] < at:
                        tables.pop()
                    while rows and leave[rows[-1]] < at:
                        rows.pop()
                    if tables:
                        self.coded.add(tables[-1])
                    if rows:
                        self.links.setdefault(rows[-1], attrs["href"])
            elif role == HEADING_CELL:
                self.headings.append(at)
            elif role == PICTURE:
                self.pictures.append(at)
            elif self.body is None:
                self.body = at

    def inside(self, places: list[int], at: int) -> list[int]:
        """Those of ascending places that are inside an element."""
        return places[bisect_right(places, at) : bisect_right(places, self.leave[at])]

    def text(self, at: int) -> str:
        """The text inside an element: the texts in order, white space as one blank, without the blank ones."""
        return " ".join(self.texts[bisect_right(self.places, at) : bisect_right(self.places, self.leave[at])])

    def blocks(self) -> list[tuple[int, str]]:
        """Place and text of each drawing's element. What a table says is said by the tables around it, so the outermost one has none around it."""
        tables = [(at, self.text(at)) for at in self.outer]
        body = self.body or 0
        return [x for x in tables if BLOCK_MARK in x[1].upper()] or [(body, self.text(body))]

    def number(self, block: int, remark: str | None, file: str | None) -> str | None:
        """What the first element says that says nothing but a number, one around a text that is one; or what the page's anchor, remark or file says."""
        around = {x for at, found in self.numbers if block < at <= self.leave[block] for x in found if x > block}
        own = next((text for text in map(self.text, sorted(around)) if is_number(text)), None)
        anchor = self.name if self.name is not None and is_number(self.name) else None
        return next((x for x in (own, anchor) if x is not None), None) or remark or file or None

    def listed(self, table: int) -> bool:
        """Whether a table lists parts, as its heading cells say, or its own links to a code."""
        said = " ".join(map(self.text, self.inside(self.headings, table))).upper()
        return "POS" in said and ("MATRIC" in said or "DESCRIZIONE" in said) or table in self.coded

    def parts(self, block: int) -> list[tuple[int, list[str], str | None]]:
        """place, cells (texts), link (to a code, or None) of every row of a block's tables of parts."""
        rows = [r for t in self.inside(self.tables, block) if self.listed(t) for r in self.rows.get(t, ())]
        return [(r, [self.text(c) for c in self.cells[r]], self.links.get(r)) for r in rows if r in self.cells]

    def headers(self, block: int) -> tuple[list[dict], str | None]:
        """What headings and paragraphs of a block say, and the source of its image, None without one."""
        said = [{"at": x, "tag": self.reader.kinds[self.said[x]][0], "said": text} for x in self.inside(self.lines, block) if (text := self.text(x))]
        pictures = [self.reader.kinds[self.said[x]] for x in self.inside(self.pictures, block)]
        pictures = [x for x in pictures if IMAGE in self.reader.lists["classes"][x[1]]] or pictures
        return said, dict(self.reader.lists["attrs"][pictures[0][2]]).get("src", "") if pictures else None


def is_part() -> Column:
    return F.col("link").isNotNull() & (F.size("cells") >= 3)


def parts_of(rows: DataFrame) -> DataFrame:
    """page_id, block, drawing, place, position, code, description (without note marks), quantity, notes (numbers, in order)."""
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(cell(2), NOTE_MARK, ""), r"^[ -]+|[ -]+$", "")
    return rows.where(is_part()).select(
        *KEY, "place", F.when(cell(0).rlike(POSITION), cell(0)).otherwise("").alias("position"), F.trim(F.regexp_extract("link", CODE, 1)).alias("code"),
        F.regexp_replace(bare, r"\s+", " ").alias("description"), cell(3).alias("quantity"), F.regexp_extract_all(cell(2), F.lit(NOTE_MARK), F.lit(1)).alias("notes"),
    )


def _lines(rows: DataFrame) -> DataFrame:
    """Rows without a part, with what they say: a state of validity goes on until a serial number has been read."""
    line = F.array_join(F.filter("cells", lambda x: x != ""), " ")
    own = rows.where(~F.coalesce(is_part(), F.lit(False))).select(*KEY, "place", F.trim(line).alias("line")).where("line <> ''")
    said = F.col("line")
    kind = F.when(said.rlike(VALID_UNTIL), "until").when(said.rlike(VALID_SINCE), "since").when(said.rlike(NOTE), "note").otherwise("text")
    serial = F.nullif(F.regexp_extract("line", SERIAL, 1), F.lit(""))
    own = own.withColumn("kind", kind).withColumn("serial", serial)
    turn = F.col("kind").isin("until", "since")
    so_far = Window.partitionBy(*KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("turn", F.sum(turn.cast("int")).over(so_far)).withColumn("note_no", F.sum((F.col("kind") == "note").cast("int")).over(so_far))
    in_turn = Window.partitionBy(*KEY, "turn").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("state", F.first(F.when(turn, F.col("kind"))).over(in_turn)).withColumn("carried", F.first(F.col("serial")).over(in_turn).isNotNull())
    plain = (F.col("kind") == "text") & F.col("serial").isNotNull()
    nth = F.sum(plain.cast("int")).over(in_turn)
    return own.withColumn("used", F.when(turn, F.lit(True)).otherwise(F.coalesce(plain & F.col("state").isNotNull() & ~F.col("carried") & (nth == 1), F.lit(False))))


def validity_of(rows: DataFrame) -> DataFrame:
    """page_id, block, drawing, valid_from, valid_to (the last of each, or ''), validity_text."""
    used = _lines(rows).where("used")
    last = lambda state: F.coalesce(F.max_by("serial", F.when((F.col("state") == state) & F.col("serial").isNotNull(), F.col("place"))), F.lit(""))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), " ")
    return used.groupBy(*KEY).agg(last("since").alias("valid_from"), last("until").alias("valid_to"), said.alias("validity_text"))


def notes_of(rows: DataFrame) -> DataFrame:
    """page_id, block, drawing, note, text; the last note of a number counts."""
    lines = _lines(rows).where((F.col("note_no") > 0) & ~F.col("used"))
    is_note = F.col("kind") == "note"
    own, follows = F.max(F.when(is_note, F.trim(F.regexp_extract("line", NOTE, 2)))), F.min_by("line", F.when(~is_note, F.col("place")))
    each = lines.groupBy(*KEY, "note_no").agg(F.max(F.when(is_note, F.regexp_extract("line", NOTE, 1))).alias("note"), F.coalesce(F.nullif(own, F.lit("")), follows, F.lit("")).alias("text"))
    return each.groupBy(*KEY, "note").agg(F.max_by("text", "note_no").alias("text"))


def headers_of(said: Column) -> Column:
    """machine, models, title of a block's drawing, of what its headings and paragraphs say; null where it has none."""
    machine = lambda m: N.head(F.filter(m, lambda x: (x["tag"] != "p") & ~x["said"].rlike(f"^{DRAWING_ID}$")))["said"]
    models = lambda m: N.head(F.filter(m, lambda x: (x["tag"] == "p") & x["said"].rlike(MODELS) & x["said"].contains("/")))
    loud = lambda x: (x["tag"] == "p") & (x["said"] == F.upper(x["said"])) & (x["said"] != F.lower(x["said"])) & (F.length(x["said"]) > 3)
    other = lambda x, f: (x["said"] != F.coalesce(f["machine"], F.lit(""))) & ~F.coalesce(x["at"] == f["models"]["at"], F.lit(False))
    first = F.struct(machine(said).alias("machine"), models(said).alias("models"))
    return N.let(first, lambda f: F.struct(f["machine"].alias("machine"), f["models"]["said"].alias("models"), N.head(F.filter(said, lambda x: loud(x) & other(x, f)))["said"].alias("title")))


class NewDrawings:
    """The drawings of these pages: each of `parts`, `notes`, `validity` and `headers` reads a page once and moves none of it. What a page says is selected
    where it is read, so that its nodes go nowhere."""

    def __init__(self, pages: DataFrame):
        own = {"remark": F.regexp_extract("html", REMARK_ID, 1), "file": F.regexp_extract(file_of(F.col("url")), ANY_ID, 1), "cell": one_blank(F.regexp_extract("html", TITLE_CELL, 1))}
        self.pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *[c.alias(k) for k, c in own.items()], "html").where("html <> ''")

    def _read(self, said_of: Callable, schema: str, *keep: str) -> DataFrame:
        """page_id, block (the place of the drawing's element), drawing, <keep>, and the rows that said_of(page, block, its text, its rows) gives; only blocks
        of a number and with parts."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, found, read = N.page_reader(False), [], 0
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "remark", "file", *keep)]
                for (page_id, remark, file, *own), html in zip(zip(*columns, strict=True), batch.column("html"), strict=True):
                    page = _Page(reader, html.as_py())
                    read += len(page.said)
                    for block, text in page.blocks():
                        number = page.number(block, remark, file)
                        parts = page.parts(block) if number is not None else []
                        if any(link is not None and len(cells) >= 3 for _, cells, link in parts):
                            found += [(page_id, block, number, *own, *x) for x in said_of(page, block, text, parts)]
                    if found and read >= 8 * N.BATCH:
                        yield N.batch_of(found, arrow)
                        found, read = [], 0
            if found:
                yield N.batch_of(found, arrow)

        kept = "".join(f", {c} string" for c in keep)
        schema = f"page_id long, block int, drawing string{kept}, {schema}"
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return self.pages.mapInArrow(rows, schema)

    def _rows(self) -> DataFrame:
        return self._read(lambda page, block, text, parts: parts, "place int, cells array<string>, link string")

    def parts(self) -> DataFrame:
        return parts_of(self._rows())

    def notes(self) -> DataFrame:
        return notes_of(self._rows())

    def validity(self) -> DataFrame:
        return validity_of(self._rows())

    def headers(self) -> DataFrame:
        """page_id, block, drawing, grp, number, machine, models, title, date, image of each drawing."""
        read = self._read(lambda page, block, text, parts: [(text, *page.headers(block))], "text string, said array<struct<at:int, tag:string, said:string>>, src string", "url", "cell")
        found = read.withColumn("said", headers_of(F.col("said"))).select(*KEY, "text", "url", "cell", "said.*", "src")
        none = F.lit("")
        url = F.coalesce("url", none)
        image = F.when(F.col("src").isNull(), none).when(url != "", absolute(url, F.col("src"))).otherwise(F.col("src"))
        number = F.when(F.col("drawing").contains("_"), F.regexp_replace("drawing", "^[^_]*_", "")).otherwise(none)
        return found.select(
            *KEY, F.substring_index("drawing", "_", 1).alias("grp"), number.alias("number"), F.coalesce("machine", none).alias("machine"), F.coalesce("models", none).alias("models"),
            F.coalesce("title", "cell", none).alias("title"), F.regexp_extract("text", DATE, 1).alias("date"), image.alias("image"),
        )
