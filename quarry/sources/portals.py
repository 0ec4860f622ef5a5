"""Rows from the pages of catalog portals, by Spark's own functions: drawings in the old text format, releases, viewers, clickable
positions, the parts master and attachments.

Every function takes pages with page_id and html; null pages and pages without the sought marks give no rows. A page's rows are never
compared with another page's, and windows are over one drawing of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the old drawing format: a line ends with its drawing in a comment, a part is a position and a link with a code.
LINE_END = r"<br\s*/?>\s*<!--\s*(\d+)\s*-->"
LINE = rf"(?is)\G.*?{LINE_END}"  # each begins where the last one ended: what follows the last line is looked through once, not from each of its characters
PART = rf"""(?i)(\d+)\s+<a[^>]*CODICE=([^"&]+)[^>]*>[^<]+</a>\s*(.*?)\s*{LINE_END}"""
NOTE_MARK = r"\((\d+)\)"
NOTE = r"^\s*\((\d+)\)\s*(.*)$"
SERIAL = r"\b([A-Z]\d{5,7})\b"
VALID_UNTIL = r"(?i)(VALIDO|VALIDA)\s+FINO\s+ALLA?\s+MACCHINA"
VALID_SINCE = r"(?i)(VALIDO|VALIDA)\s+DALLA?\s+MACCHINA"
HEADER = r"(?i)GR\s*TAV\s*(\d+)\s+(\d+)\s*([\d.]+)?"
GROUP_PAGE = "TAVOLE COMPONENTI IL GRUPPO"
DISMISSED = "$DISMISSED"


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def table_rows(c: Column) -> Column:
    return found(c, r"(?is)<tr\b.*?(?=<tr\b|</tr>|</table>|\z)")


def row_cells(c: Column) -> Column:
    return found(c, r"(?is)<td\b.*?(?=<td\b|</td>|\z)")


def text_lines(c: Column) -> Column:
    """The pieces of text between tags and line ends, trimmed, without the blank ones."""
    bare = F.replace(F.replace(F.regexp_replace(c, r"<[^>]*>", "\n"), F.lit("&nbsp;"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    return F.filter(F.transform(F.split(F.replace(bare, F.lit("&amp;"), F.lit("&")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def plain(c: Column) -> Column:
    return F.array_join(text_lines(c), " ")


def cleaned(c: Column) -> Column:
    """Without tags, and with one blank for each run of white space."""
    bare = F.replace(F.replace(F.regexp_replace(c, r"<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def drawing_format(c: Column) -> Column:
    """Old before new; a page of neither may still list a group's drawings."""
    up = F.upper(c)
    old = c.contains("POS") & c.contains("MATRIC") & c.contains("CODICE=") & c.rlike(PART)
    new = up.contains("CODICE=") & up.contains("POS.") & (up.contains("GR TAV") | up.contains("MATRIC")) & up.contains("<TR")
    group = c.contains('class="grup"') | up.contains(GROUP_PAGE)
    return F.when(old, "old").when(new, "new").when(group, "group").otherwise("none")


def old_lines(pages: DataFrame) -> DataFrame:
    """page_id, place, drawing, raw and clean text of each line of an old page."""
    raw = pages.select("page_id", F.posexplode(found(F.col("html"), LINE)).alias("place", "raw"))
    drawing = F.regexp_extract("raw", rf"(?is){LINE_END}$", 1)
    return raw.select("page_id", "place", drawing.alias("drawing"), "raw", cleaned(F.regexp_replace("raw", rf"(?is){LINE_END}$", "")).alias("line"))


def is_part() -> Column:
    """Whether a raw line is a part; few lines that are none name a code."""
    return F.upper("raw").contains("CODICE=") & F.col("raw").rlike(PART)


def old_parts(pages: DataFrame) -> DataFrame:
    """page_id, place, drawing, position, code, description (without note marks), notes (numbers, in order)."""
    group = lambda k: F.regexp_extract("raw", PART, k)
    description = F.trim(F.regexp_replace(F.regexp_replace("rest", NOTE_MARK, ""), r"\s+", " "))
    notes = F.regexp_extract_all("rest", F.lit(NOTE_MARK), F.lit(1))
    lines = old_lines(pages).where(is_part())
    lines = lines.select("page_id", "place", "drawing", group(1).alias("position"), F.trim(group(2)).alias("code"), cleaned(group(3)).alias("rest"))
    return lines.select("page_id", "place", "drawing", "position", "code", description.alias("description"), notes.alias("notes"))


def _states(pages: DataFrame) -> DataFrame:
    """Lines other than parts, of drawings that have parts, with what they say and the state they are read in.

    A serial number counts only if it is the first since a line of validity; a note's text may follow on a later line.
    """
    drawing = Window.partitionBy("page_id", "drawing")
    so_far = drawing.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = old_lines(pages).withColumn("has_parts", F.max(is_part()).over(drawing))
    own = own.where(F.col("has_parts") & (F.col("line") != "") & ~F.col("raw").contains("CODICE="))
    line = F.col("line")
    kind = F.when(line.rlike(VALID_UNTIL), "until").when(line.rlike(VALID_SINCE), "since").when(line.rlike(NOTE), "note").when(line.rlike(SERIAL), "serial").otherwise("text")
    own = own.select("page_id", "drawing", "place", "line", kind.alias("kind"))
    turns = F.col("kind").isin("until", "since")
    own = own.withColumn("state", F.last(F.when(turns, F.col("kind")), ignorenulls=True).over(so_far))
    own = own.withColumn("state_no", F.sum(turns.cast("int")).over(so_far)).withColumn("note_no", F.sum((F.col("kind") == "note").cast("int")).over(so_far))
    since_turn = Window.partitionBy("page_id", "drawing", "state_no").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.sum((F.col("kind") == "serial").cast("int")).over(since_turn)
    return own.withColumn("used", (F.col("kind") == "serial") & (F.col("state_no") > 0) & (nth == 1))


def old_validity(pages: DataFrame) -> DataFrame:
    """page_id, drawing, valid_from, valid_to (the last of each), validity_text; only drawings with a validity."""
    used = _states(pages).where("used").withColumn("serial", F.regexp_extract("line", SERIAL, 1))
    last = lambda state: F.coalesce(F.max_by("serial", F.when(F.col("state") == state, F.col("place"))), F.lit(""))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), " ")
    return used.groupBy("page_id", "drawing").agg(last("since").alias("valid_from"), last("until").alias("valid_to"), said.alias("validity_text"))


def old_notes(pages: DataFrame) -> DataFrame:
    """page_id, drawing, note, text: its own line's text, or else the next line that says nothing else; the last of a number counts."""
    lines = _states(pages).where((F.col("note_no") > 0) & ~F.col("used") & F.col("kind").isin("note", "serial", "text"))
    is_note = F.col("kind") == "note"
    own, follows = F.max(F.when(is_note, F.trim(F.regexp_extract("line", NOTE, 2)))), F.min_by("line", F.when(~is_note, F.col("place")))
    each = lines.groupBy("page_id", "drawing", "note_no").agg(F.max(F.when(is_note, F.regexp_extract("line", NOTE, 1))).alias("note"), F.coalesce(F.nullif(own, F.lit("")), follows, F.lit("")).alias("text"))
    return each.groupBy("page_id", "drawing", "note").agg(F.max_by("text", "note_no").alias("text"))


def old_headers(pages: DataFrame) -> DataFrame:
    """page_id, drawing, machine, models, title, date, image from the tables whose last row names a drawing of the page."""
    tables = pages.select("page_id", F.posexplode(found(F.col("html"), r"(?is)<table\b.*?</table>")).alias("tab", "html"))
    last_of = tables.select("page_id", "tab", "html", table_rows(F.col("html")).alias("rows")).where("size(rows) >= 2")
    rows = last_of.select("page_id", "tab", "html", row_cells(F.element_at("rows", -1)).alias("cells")).where("size(cells) >= 3")
    rows = rows.select("page_id", "tab", "html", "cells", plain(F.col("cells")[2]).alias("head")).where(F.col("head").rlike(HEADER)).withColumn("first", text_lines(F.col("cells")[0]))
    part = lambda k: F.regexp_extract("head", HEADER, k)
    rest = F.slice("first", 3, F.greatest(F.size("first") - 2, F.lit(0)))
    named = rows.select(
        "page_id", "tab", F.concat(part(1), part(2)).alias("drawing"), F.array_join(F.slice("first", 1, 2), " ").alias("machine"), F.array_join(rest, " ").alias("models"),
        plain(F.col("cells")[1]).alias("title"), part(3).alias("date"), F.regexp_extract("html", r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)""", 1).alias("image"),
    )
    fields = ["machine", "models", "title", "date", "image"]
    last = named.groupBy("page_id", "drawing").agg(F.max_by(F.struct(*fields), "tab").alias("h")).select("page_id", "drawing", "h.*")
    return last.join(old_parts(pages).select("page_id", "drawing").distinct(), ["page_id", "drawing"], "left_semi")


def releases(pages: DataFrame) -> DataFrame:
    """page_id, place, release, description, document, date: rows that open a release, their cells counted from the right."""
    rows = pages.select("page_id", F.posexplode(table_rows(F.col("html"))).alias("place", "row"))
    release = F.regexp_extract("row", r"openSelectedRelease\((\d+)\)", 1)
    cells = F.transform(row_cells(F.col("row")), plain)
    three = F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))))
    at = lambda k: F.element_at(three, k)
    return rows.where(release != "").select("page_id", "place", release.cast("long").alias("release"), at(-3).alias("description"), at(-2).alias("document"), at(-1).alias("date"))


def viewer(pages: DataFrame) -> DataFrame:
    """page_id, folder, place, drawing, number, title of a viewer page; a drawing's mark holds no further mark of its kind."""
    folder = F.nullif(F.regexp_extract("html", r"""dir:\s*["']([^"']+)["']""", 1), F.lit(""))
    marks = pages.select("page_id", folder.alias("folder"), F.posexplode(found(F.col("html"), r"(?is)<div\b[^>]*\btableid\s*=[^>]*>.*?</div>")).alias("place", "mark"))
    attribute = lambda name: F.regexp_extract("mark", rf"""(?is)^<div\b[^>]*?\b{name}\s*=\s*["']([^"']*)""", 1)
    label = plain(F.col("mark"))
    rest = F.when(label.contains(" - "), F.regexp_replace(label, r"(?s)^.*? - ", "")).otherwise("")
    title = F.trim(F.coalesce(F.nullif(attribute("tabledescription"), F.lit("")), F.nullif(rest, F.lit("")), label))
    return marks.select("page_id", "folder", "place", attribute("tableid").try_cast("long").alias("drawing"), F.trim(F.substring_index(label, " - ", 1)).alias("number"), title.alias("title"))


def clickable_positions(pages: DataFrame) -> DataFrame:
    """page_id, product, tab, row, label of an SVG's texts that open a part; of one (tab, row) the first."""
    marks = pages.select("page_id", F.posexplode(found(F.col("html"), r"(?s)<text\b[^>]*>.*?</text>")).alias("place", "mark"))
    opens = r"openDialogSVG\(\s*(\d+)\s*,\s*'([^']*)'\s*,\s*(\d+)\s*\)"
    at = lambda k: F.regexp_extract("mark", opens, k)
    rows = marks.where(F.col("mark").rlike(opens)).select("page_id", "place", at(1).cast("long").alias("product"), at(2).alias("tab"), at(3).cast("long").alias("row"), F.trim(F.regexp_replace("mark", r"<[^>]+>", "")).alias("label"))
    first = rows.groupBy("page_id", "tab", "row").agg(F.min_by(F.struct("product", "label"), "place").alias("first"))
    return first.select("page_id", "first.product", "tab", "row", "first.label")


def number(c: Column) -> Column:
    """A number with points between thousands and a decimal comma; null where it is none."""
    return F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def parts_master(pages: DataFrame, base: str = "") -> DataFrame:
    """A page's parts: grid rows of seven cells or more with a code; a dismissed part has no replacement."""
    rows = pages.select("page_id", F.posexplode(table_rows(F.col("html"))).alias("place", "row"))
    rows = rows.where(F.col("row").rlike(r"""(?i)<td\b[^>]*\bclass\s*=\s*["'][^"']*\bwGridRow01\b""")).select("page_id", "place", row_cells(F.col("row")).alias("raw")).where("size(raw) >= 7")
    rows = rows.select("page_id", "place", F.col("raw")[0].alias("photo"), F.transform("raw", plain).alias("c"))
    c = F.col("c")
    gone = F.startswith(F.upper(c[4]), F.lit(DISMISSED))
    photo = F.nullif(F.regexp_extract("photo", r"openImage\(\s*'(?:[^'\\]|\\.)*'\s*,\s*'([^']+)'", 1), F.lit(""))
    return rows.where(c[2] != "").select(
        "page_id", "place", c[2].alias("code"), c[1].alias("company"), c[3].alias("description"), F.when(~gone, F.nullif(c[4], F.lit(""))).alias("replaced_by"), gone.alias("dismissed"),
        number(c[5]).alias("least"), number(c[6]).alias("weight"), F.concat(F.lit(base), photo).alias("photo"),
    )


def attachments(pages: DataFrame) -> DataFrame:
    """page_id, place, name, url (opened by a click, or else linked), kind, size, note of a product's documents."""
    articles = pages.select("page_id", F.posexplode(found(F.col("html"), r"(?is)<article\b[^>]*\bsingledocument\b.*?</article>")).alias("place", "a"))
    opened = F.regexp_extract("a", r"""(?is)^<article\b[^>]*window\.open\(\s*['"]([^'"]+)['"]""", 1)
    linked = F.regexp_extract("a", r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)""", 1)
    of = lambda mark: plain(F.regexp_extract("a", rf"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*\b{mark}\b[^>]*>(.*?)</\1>""", 2))
    info = of("doc_info")
    return articles.select(
        "page_id", "place", plain(F.regexp_extract("a", r"(?is)<h3\b[^>]*>(.*?)</h3>", 1)).alias("name"), F.coalesce(F.nullif(opened, F.lit("")), linked).alias("url"),
        F.regexp_extract(info, r"Tipo\s*:\s*(\S+)", 1).alias("kind"), F.regexp_extract(info, r"Dimensione\s*:\s*([\d.,]+\s*\w+)", 1).alias("size"), of("doc_abstract").alias("note"),
    )
