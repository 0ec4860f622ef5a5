"""Rows from pages: links, tables and headings, by Spark's own functions where a pattern says it all, and by one streaming parser for tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Files that are no pages.
BINARY = ("pdf", "jpg", "jpeg", "gif", "png", "zip", "exe", "doc", "xls")


def links(pages: DataFrame) -> DataFrame:
    """page_id, place, url: targets of links, areas and frames made absolute, without fragments, each once in order, files left out."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<(?:a|area|frame|iframe)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"'#]+)"""))
    at = pages.select("page_id", "url", F.posexplode(found).alias("i", "h")).where("trim(h) <> ''")
    root = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^([a-z]+://[^/]+(?:/.*/|/)?)", 1)
    h = F.trim("h")
    absolute = F.when(h.rlike(r"^[a-z]+:"), h).when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract("url", r"^([a-z]+:)", 1), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), h))
    kept = at.select("page_id", "i", absolute.alias("url")).where(~F.lower("url").rlike(r"\.(" + "|".join(BINARY) + r")(\?|$)"))
    once = kept.groupBy("page_id", "url").agg(F.min("i").alias("i"))
    return once.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("i")).alias("place"), "url")


def title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_kind(c: Column) -> Column:
    """The first extractor whose mark the page shows."""
    return F.when(c.rlike(r"(?i)<table\b"), "table").when(c.rlike(r"(?i)<(ul|ol)\b"), "list").otherwise("text")


def page_total(c: Column) -> Column:
    """The largest number after "of", "di" or "/" in a pager."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)\b\d+\s*(?:of|di|/)\s*(\d+)"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.try_cast("long")))


class _Tables(HTMLParser):
    """Cells of all tables: (table, row, column, text, href of the first link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, str, str | None]] = []
        self.table = self.row = self.column = -1
        self.text: list[str] | None = None
        self.href: str | None = None

    def _close(self) -> None:
        if self.text is not None:
            self.cells.append((self.table, self.row, self.column, " ".join("".join(self.text).split()), self.href))
            self.text = self.href = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close()
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._close()
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self._close()
            self.column, self.text = self.column + 1, []
        elif tag == "a" and self.text is not None and self.href is None:
            self.href = dict(attrs).get("href")
        elif tag == "br" and self.text is not None:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)


def table_cells(pages: DataFrame) -> DataFrame:
    """S6, S8, S9, S11, S12 begin here: page_id, tab, row, col, text, href of every table cell; selecting rows and naming columns is left to DataFrame functions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                parser = _Tables()
                parser.feed(html or "")
                parser._close()
                out += [(page, *cell) for cell in parser.cells]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["page_id", "tab", "row", "col", "text", "href"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(rows, "page_id long, tab int, row int, col int, text string, href string")


def wide_rows(cells: DataFrame, columns: list[str], least: int) -> DataFrame:
    """Rows of at least `least` cells as named columns, with the row's first link."""
    wide = cells.groupBy("page_id", "tab", "row").agg(F.max("col").alias("_last"), F.min_by("href", F.when(F.col("href").isNotNull(), F.col("col"))).alias("href"), *[F.max(F.when(F.col("col") == i, F.col("text"))).alias(c) for i, c in enumerate(columns)])
    return wide.where(F.col("_last") + 1 >= least).drop("_last")


def keep_first(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key on a page the first."""
    w = Window.partitionBy("page_id", key).orderBy("tab", "row")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def json_items(c: Column) -> Column:
    """[{id, des}, ...] as an array of structs."""
    return F.from_json(c, "array<struct<id:string,des:string>>")


def pick(obj: Column, *keys: str) -> Column:
    """The first of several fields of a JSON object that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(obj, f"$.{k}")), F.lit("")) for k in keys])


def truth(c: Column) -> Column:
    """Y, true and 1 in any case are true; N, false, 0 and all else are false."""
    return F.coalesce(F.lower(F.trim(c)).isin("y", "true", "1"), F.lit(False))
