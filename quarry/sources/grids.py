"""Tables of parts from cell grids (grid, row, col, text), where a null text is a cell that a merged one covers.

A grid's header is its first row with a number column and a code column; each number column begins a table of its own, which goes on to the next
one, so that tables side by side come apart. A second half without a header is found by its codes. Quantities stand in one column, in columns
headed by models, in lists beside the models, or in brackets for the models in brackets at the description's end. Windows are over one grid.

Every function takes cells, or rows of cells (`grid_rows`). `grid_parts` settles rows once, in buckets of grids: what follows reads a row's cells as an
array, and moves none of them between tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.shared import dealt, settle_by

# Codes, models and headings as the catalogs print them.
CODE = r"^(\d{7}|\d{5} \d{3} \d{3}[A-Z]?)$"
MODEL = r"^[A-Za-z]{1,6}\s*\d{2,3}$"
POSITION = r"^\d+[A-Za-z]?$"
HEADINGS = {"item": r"^item\s*no", "code": r"^(part|sales)\s*(no|code)", "desc": r"^(description|item name)", "qty": r"^qty$", "model": r"^model$"}
TABLE = ["grid", "tab"]


def tidy(c: Column) -> Column:
    """A cell's text: one blank for white space, and a fraction's sign where it was read as a line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\s]+", " "), r"(\w) ?_(?=\w)", "$1/"), r"\s+", " "))


def listed_models(c: Column) -> Column:
    """"MB 205, 280" -> [MB 205, MB 280]: a number alone takes the last prefix; empty if an item is neither."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    form = r"^([A-Za-z ]*?)\s*(\d{2,3})$"
    start = F.struct(F.lit("").alias("prefix"), F.array().cast("array<string>").alias("models"))

    def add(so_far, x):
        prefix = F.coalesce(F.nullif(F.trim(F.regexp_extract(x, form, 1)), F.lit("")), so_far["prefix"])
        return F.struct(prefix.alias("prefix"), F.concat(so_far["models"], F.array(F.trim(F.concat(prefix, F.lit(" "), F.regexp_extract(x, form, 2))))).alias("models"))

    return F.when(F.forall(items, lambda x: x.rlike(form)), F.aggregate(items, start, add)["models"]).otherwise(F.array().cast("array<string>"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """grid, row, cells (col, own) in order of their columns; own is the cell's text as `tidy` has it, null where the cell is covered."""
    if "cells" in cells.columns:
        return cells
    return dealt(cells, "grid").groupBy("grid", "row").agg(F.array_sort(F.collect_list(F.struct("col", tidy(F.col("text")).alias("own")))).alias("cells"))


def each(rows: DataFrame, where: Callable, *keep: str) -> DataFrame:
    """grid, row, the columns <keep>, and col and own of the cells that `where` selects."""
    return rows.select("grid", "row", *keep, F.inline(F.filter("cells", where)))


def grid_tables(cells: DataFrame) -> DataFrame:
    """grid, tab, header, start (first row of data), first, end (columns), code, desc, qty, model (columns or null)."""
    rows = grid_rows(cells)
    low = F.lower("own")
    kind = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in HEADINGS.items()])
    line = Window.partitionBy("grid", "row").orderBy("col")
    headed = each(rows, lambda c: F.lower(c["own"]).rlike("|".join(HEADINGS.values())))
    marks = headed.select("grid", "row", "col", kind.alias("kind")).withColumn("tab", F.sum((F.col("kind") == "item").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    column = lambda k: F.max(F.when(F.col("kind") == k, F.col("col")))
    found = marks.where("tab > 0").groupBy("grid", "row", "tab").agg(column("item").alias("first"), *[column(k).alias(k) for k in ("code", "desc", "qty", "model")])
    width = rows.groupBy("grid").agg((F.max(F.element_at("cells", -1)["col"]) + 1).alias("width"))
    found = found.withColumn("end", F.lead("first").over(Window.partitionBy("grid", "row").orderBy("tab"))).where("code is not null")
    header = found.groupBy("grid").agg(F.min("row").alias("header"))
    found = found.join(header, "grid").where("row = header").join(width, "grid").withColumn("end", F.coalesce("end", "width"))
    maybe = found.where("qty is null and desc is not null and desc + 3 < width").select("grid", "tab", "header", "width", (F.col("desc") + 1).alias("half"))
    coded = each(rows, lambda c: c["own"].rlike(CODE)).select("grid", "row", F.col("col").alias("at"))
    halves = maybe.join(coded, "grid").where("at = half + 1").groupBy("grid", "tab", "header", "width", "half").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("start")).where("n >= 2")
    none = F.lit(None).cast("long")
    long = lambda c: c.cast("long")
    own = found.join(halves.select("grid", "tab", "half"), ["grid", "tab"], "left").select(
        "grid", (2 * F.col("tab")).cast("long").alias("tab"), long(F.col("header")).alias("header"), long(F.col("header") + 1).alias("start"), long(F.col("first")).alias("first"),
        long(F.coalesce("half", "end")).alias("end"), *[long(F.col(k)).alias(k) for k in ("code", "desc", "qty", "model")],
    )
    hidden = halves.select(
        "grid", (2 * F.col("tab") + 1).cast("long").alias("tab"), long(F.col("header")).alias("header"), long(F.col("start")).alias("start"), long(F.col("half")).alias("first"),
        long(F.col("width")).alias("end"), long(F.col("half") + 1).alias("code"), long(F.col("half") + 2).alias("desc"), none.alias("qty"), none.alias("model"),
    )
    return own.union(hidden)


def grid_titles(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """grid, title: the first row above the header with one text only that is no model."""
    heads = tables.groupBy("grid").agg(F.min("header").alias("header"))
    said = F.filter("cells", lambda c: c["own"] != "")
    above = grid_rows(cells).select("grid", "row", said.alias("said")).where("size(said) = 1").join(heads, "grid").where("row < header")
    alone = above.select("grid", "row", F.col("said")[0]["own"].alias("title")).where(~F.col("title").rlike(MODEL))
    return alone.groupBy("grid").agg(F.min_by("title", "row").alias("title"))


def model_columns(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """grid, tab, col, models of the quantity columns that rows above the header name, in tables with more than one of them."""
    above = grid_rows(cells).join(tables.where("qty is not null").select(*TABLE, "header", "qty", "end"), "grid").where("row < header")
    above = each(above, lambda c: (c["own"] != "") & (c["col"] >= F.col("qty")) & (c["col"] < F.col("end")), "tab")
    named = above.groupBy(*TABLE, "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "own"))), lambda x: x["own"]).alias("names"))
    models = F.when(F.forall("names", lambda x: x.rlike(MODEL)), F.col("names")).otherwise(F.array(F.array_join("names", " ")))
    return named.select(*TABLE, "col", models.alias("models"), F.count(F.lit(1)).over(Window.partitionBy(*TABLE)).alias("n")).where("n > 1").drop("n")


def grid_parts(cells: DataFrame, series: str = "") -> DataFrame:
    """grid, tab, row, position, code, description, quantity, note, models (model -> quantity). `series` goes before bare numbers in bracketed lists."""
    rows = settle_by(grid_rows(cells), "grid", is_dealt=True)
    tables = settle_by(grid_tables(rows), "grid")
    here = rows.join(tables, "grid").where("row >= start").withColumn("cells", F.filter("cells", lambda c: (c["col"] < F.col("end")) & (c["col"] >= F.least("first", F.coalesce("desc", F.lit(0)))))).where("size(cells) > 0")
    until = F.least(F.coalesce("qty", "end"), F.coalesce("model", "end"), "end")
    described = lambda c: (c["col"] >= F.coalesce("desc", F.lit(0))) & (c["col"] < until) & (c["col"] != F.col("code")) & (c["own"] != "")
    at = lambda k: F.try_element_at(F.filter("cells", lambda c: (c["col"] == F.col(k)) & (c["own"] != "")), F.lit(-1))["own"]
    text = F.array_join(F.transform(F.filter("cells", described), lambda c: c["own"]), " ")
    lines = here.select(*TABLE, "row", at("first").alias("item"), at("code").alias("said_code"), text.alias("said"), at("qty").alias("amount"), at("model").alias("listed"))
    coded = F.coalesce(F.col("said_code").rlike(CODE), F.lit(False))
    so_far = Window.partitionBy(*TABLE).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("coded", coded).withColumn("part", F.sum(F.col("coded").cast("int")).over(so_far)).where("part > 0")
    lines = lines.withColumn("position", F.last(F.when(F.col("coded") & F.col("item").rlike(POSITION), F.col("item")), ignorenulls=True).over(so_far))

    # quantities under models: a covered cell has the quantity of the cell that covers it
    columns = model_columns(rows, tables)
    by_model = columns.select(*TABLE).distinct()
    wide = each(here.join(by_model, TABLE, "left_semi"), lambda c: c["col"] >= F.col("qty"), "tab").withColumn("value", F.last("own", ignorenulls=True).over(Window.partitionBy(*TABLE, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)))
    wide = wide.where("value <> ''").join(columns, [*TABLE, "col"], "left")
    number = F.col("value").rlike(r"^\d+$")
    said = F.array_sort(F.collect_list(F.when(number & F.col("models").isNotNull(), F.struct("col", "models", "value"))))
    pairs = F.flatten(F.transform(said, lambda x: F.transform(x["models"], lambda m: F.struct(m.alias("model"), x["value"].alias("quantity")))))
    amounts = wide.groupBy(*TABLE, "row").agg(pairs.alias("pairs"), F.max_by("value", F.when(~number, F.col("col"))).alias("note"))
    lines = lines.join(amounts, [*TABLE, "row"], "left").join(by_model.withColumn("by_model", F.lit(True)), TABLE, "left").withColumn("by_model", F.coalesce("by_model", F.lit(False)))

    no_pairs = F.array().cast("array<struct<model:string,quantity:string>>")
    listed = F.transform(listed_models(F.col("listed")), lambda m: F.struct(m.alias("model"), F.col("amount").alias("quantity")))
    own_pairs = F.when(F.col("coded"), F.when(F.col("by_model"), F.coalesce("pairs", no_pairs)).when(F.col("listed").isNotNull(), listed).otherwise(no_pairs))
    more_pairs = F.when(~F.col("coded") & F.col("listed").isNotNull(), listed)
    words = F.when(F.col("coded") | F.col("listed").isNull(), F.nullif("said", F.lit("")))
    in_order = lambda c: F.array_sort(F.collect_list(F.struct("row", c.alias("x"))))
    grouped = lines.withColumn("more", F.coalesce(own_pairs, more_pairs)).withColumn("words", words).groupBy(*TABLE, "part").agg(
        F.min("row").alias("row"), *[F.min_by(c, "row").alias(c) for c in ("position", "amount", "note", "by_model")], F.min_by("said_code", "row").alias("code"),
        F.array_join(F.transform(F.filter(in_order(F.col("words")), lambda x: x["x"].isNotNull()), lambda x: x["x"]), " ").alias("description"),
        F.flatten(F.transform(F.filter(in_order(F.col("more")), lambda x: x["x"].isNotNull()), lambda x: x["x"])).alias("pairs"),
    )
    # the last quantity of a model counts
    unique = F.filter(F.transform("pairs", lambda x, i: F.struct(x["model"].alias("model"), x["quantity"].alias("quantity"), i.alias("i"))), lambda x: ~F.exists(F.slice("pairs", x["i"] + 2, F.size("pairs")), lambda y: y["model"] == x["model"]))
    grouped = grouped.withColumn("models", F.map_from_entries(F.transform(unique, lambda x: F.struct(x["model"], x["quantity"]))))

    # "(10-12)" for a description that ends with "(MB 205-MB 280)"
    names = F.transform(F.split(F.regexp_extract("description", r"\(([^()]+)\)\s*$", 1), "-"), lambda x: F.trim(x))
    names = F.transform(names, lambda x: F.when(x.rlike(r"^\d{2,3}$"), F.concat(F.lit(f"{series} "), x)).otherwise(x))
    values = F.transform(F.split(F.regexp_extract("amount", r"^\(([\d\s\-]+)\)$", 1), "-"), lambda x: F.trim(x))
    quantity = F.when(~F.col("by_model"), F.col("amount"))
    zipped = quantity.rlike(r"^\([\d\s\-]+\)$") & F.col("description").rlike(r"\([^()]+\)\s*$") & (F.size(values) == F.size(names)) & F.forall(names, lambda x: x.rlike(MODEL))
    grouped = grouped.withColumn("names", names).withColumn("values", values).withColumn("zipped", F.coalesce(zipped, F.lit(False)))
    once = F.filter(F.transform("names", lambda x, i: F.struct(x.alias("model"), F.get("values", i).alias("quantity"), i.alias("i"))), lambda x: ~F.array_contains(F.slice("names", x["i"] + 2, F.size("names")), x["model"]))
    models = F.when(F.col("zipped"), F.map_from_entries(F.transform(once, lambda x: F.struct(x["model"], x["quantity"])))).otherwise(F.col("models"))
    description = F.when(F.col("zipped"), F.trim(F.regexp_replace("description", r"\([^()]+\)\s*$", ""))).otherwise(F.col("description"))
    grouped = grouped.withColumn("models", models).withColumn("description", description)
    distinct = F.array_distinct(F.transform(F.map_values("models"), lambda x: F.coalesce(x, F.lit(""))))
    final = F.when(F.size(distinct) > 1, F.lit(None)).when(F.col("by_model"), F.get(distinct, F.lit(0))).otherwise(F.col("amount"))
    return grouped.select(*TABLE, "row", "position", "code", "description", final.alias("quantity"), "note", "models")
