"""Pages as a table of nodes in document order, and selections over it as joins.

`page_nodes` reads each page once, streaming, and gives a row for the page, and for every element, text and comment: its place (`enter`), the last place inside
it (`leave`), its ancestors' places (`path`, outermost first) and their marks (`around`: tags, .classes and #ids; elements alone have it), tag, classes, attributes and own text. What is inside what is then an equi-join
of a path with places (an inner node's enter lies between the outer's enter and leave), the nearest enclosing element the one of
largest enter, and the first inner one that of the least; no selection compares all nodes of a page with all others.

`page_arrays` gives the same nodes as one row a page, in an array where an element's place is its index and what is inside it one slice. Selections over it
(`each`, `inside`, `text_of`) are columns of that row: nothing is dealt, sorted or settled, and what is read is as much as the slices hold.

Elements that need no end tag are closed as browsers do for lists, paragraphs and tables; what stays open ends with its page. Null and empty
pages have no nodes. Texts of scripts and styles are kept apart from other texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html import parser, unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.shared import dealt, settle_by

SCHEMA = "page_id long, enter int, leave int, path array<int>, around array<string>, tag string, classes array<string>, attrs map<string,string>, text string"
NODE = "enter int, leave int, path array<int>, around array<string>, tag string, classes array<string>, attrs map<string,string>, text string"
BATCH = 1 << 13  # nodes that go out at once, or one page's
PAGE, TEXT, COMMENT, RAW = "#page", "#text", "#comment", "#raw"
# Fixed values of the page language: elements without an end, those whose text is no text, and which open elements a new one ends, up to a limit.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"script", "style", "template"}
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


# Plain markup, which most pages are, is cut at its brackets, each kind of tag judged once by this pattern; a page with anything else goes to HTMLParser as a whole.
ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z][\w:-]*)(?:=(?:'([^']*)'|"([^"]*)"|([^\s"'=<>`&/]+)))?"""
PLAIN = re.compile(
    r"""/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*|(?!(?:script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)\b)([a-zA-Z][a-zA-Z0-9]*)((?:%s)*)[ \t\n\r\f]*"""
    r"""|(script|title)|!--([^<>-]*(?:-[^<>-]+)*)--""" % re.sub(r"\((?!\?)", "(?:", ATTRIBUTE),
    re.IGNORECASE | re.ASCII,
)
ATTRIBUTES = re.compile(ATTRIBUTE, re.ASCII).findall
SLOT = "\0"  # stands for a quoted value in the shape of a piece of markup, which is judged once for all values
ENDED, STARTED, WHOLE, REMARK, ODD = range(5)  # what a piece of markup is: an end, a start, a start whose element has text only, a comment, or not plain


class _Nodes(HTMLParser):
    """The nodes of pages, page after page, as columns, which hold no object a node: lists that nodes share (paths, marks, classes, attributes) are
    written once, and a node has their number. What a tag closes and opens depends on the open elements alone: it is found once for each of their states."""

    def __init__(self, paths: bool = True):
        super().__init__(convert_charrefs=True)
        self.has_paths = paths
        self.clear()
        self.begin()

    def clear(self) -> None:
        """No page, and no list but the empty one, which is number 0."""
        self.said, self.path = [], []  # of every node: the number of its (tag, classes, attrs), and of its path
        self.around, self.text = [], []  # of every element, and of every other node
        self.shut, self.last = [], []  # of every closed element: its number among the nodes, and the last place inside it
        self.first: list[int] = []  # numbers of the pages' first nodes
        self.kinds: list[tuple] = list(LEAVES)
        self.lists: dict[str, list] = {k: [()] for k in ("path", "around", "classes", "attrs")}
        self.numbers: dict[str, dict] = {k: {(): 0} for k in ("around", "classes", "attrs")}
        self.marks: dict[tuple, int] = {}  # numbers of an element's own marks
        self.tags: dict[str, tuple] = {}  # kind and content of a piece of markup
        self.shapes: dict[str, tuple | None] = {}  # what is the same for all values of a shape
        self.states: list[tuple] = []  # tags of the open elements, and the marks inside each
        self.places: dict[tuple, int] = {}
        self.moves: dict[tuple, tuple] = {}  # by state and own marks: open elements left, marks around, state after it, whether it stays open
        self.ends: dict[tuple, tuple | None] = {}  # by state and tag: open elements left, state after it
        self.outside = self.state_of((), ())
        self.page_kind = self.start_of(PAGE, [])

    def begin(self) -> None:
        self.base = len(self.said)  # places count from the page's first node
        self.first.append(self.base)
        self.open: list[int] = []  # numbers of the open elements
        self.paths: list[int] = [0]
        self.state = self.outside
        self.start(self.page_kind)

    def add(self, html: str) -> None:
        """The nodes of one more page."""
        columns = (self.said, self.path, self.around, self.text, self.shut, self.last, self.first)
        before = [len(c) for c in columns]
        self.begin()
        if not self.read(html):
            for column, size in zip(columns, before, strict=True):
                del column[size:]
            self.begin()
            self.reset()
            self.feed(html)
            self.close()
        self.close_from(0)

    def page(self, html: str) -> tuple[list[int], list[int], list[str]]:
        """The nodes of one page, until the next is asked for: the number of each one's kind, the last place inside it, and the texts of those that are no
        elements. What is known of kinds of tags goes on from page to page."""
        if max(len(self.kinds), len(self.tags), len(self.states)) > BATCH:
            self.clear()
        for column in (self.said, self.path, self.around, self.text, self.shut, self.last, self.first):
            column.clear()
        self.add(html)
        leave = list(range(len(self.said)))
        for at, last in zip(self.shut, self.last, strict=True):
            leave[at] = last
        return self.said, leave, self.text

    def updatepos(self, i, j):
        return j  # lines and columns of the page are not asked for

    def read(self, html: str) -> bool:
        """Reads a page of plain markup; False, and then nothing of it counts, if it is not. Starts, ends and texts are taken here as `start`,
        `handle_endtag` and `handle_data` take them, without their calls."""
        said, around, opened, shut, last, path = self.said, self.around, self.open, self.shut, self.last, self.path
        tags, moves, ends, base, has_paths = self.tags, self.moves, self.ends, self.base, self.has_paths
        pieces = iter(html.split("<"))
        text = next(pieces)
        if text:
            self.handle_data(unescape(text) if "&" in text else text)
        for piece in pieces:
            mark, closed, text = piece.partition(">")
            found = tags.get(mark)
            if found is None:
                found = tags[mark] = self.judge(mark)
            kind, content = found
            if not closed or kind == ODD:
                return False
            if kind == STARTED:
                own, marks, number = content
                move = moves.get((self.state, number))
                if move is None:
                    move = moves[self.state, number] = self.move(marks)
                depth, outer, self.state, stays = move
                at = len(said)
                if len(opened) > depth:
                    self.close_from(depth)
                said.append(own)
                around.append(outer)
                if has_paths:
                    path.append(self.paths[-1])
                if stays:
                    opened.append(at)
                    if has_paths:
                        self.open_path(at - base)
            elif kind == ENDED:
                key = (self.state, content)
                end = ends.get(key, ends)
                if end is ends:
                    end = ends[key] = self.end_of(content)
                if end:
                    depth, self.state = end
                    if len(opened) == depth + 1:
                        shut.append(opened.pop())
                        last.append(len(said) - base - 1)
                        if has_paths:
                            del self.paths[depth + 1 :]
                    else:
                        self.close_from(depth)
            elif kind == REMARK:
                self.handle_comment(content)
            else:
                mark, closed, after = next(pieces, "").partition(">")
                tag = content[1][0]
                if not closed or mark.lower() != "/" + tag:
                    return False
                self.start(content)
                self.handle_data(unescape(text) if tag == "title" else text)
                self.handle_endtag(tag)
                text = after
            if text and not text.isspace():
                self.handle_data(unescape(text) if "&" in text else text)
        return True

    def judge(self, mark: str) -> tuple:
        single, double = "'" in mark, '"' in mark
        if single != double and SLOT not in mark:
            quote = "'" if single else '"'
            cut = mark.split(quote)
            shape = (quote + SLOT + quote).join(cut[::2])
            if shape not in self.shapes:
                self.shapes[shape] = self.shape_of(shape)
            if len(cut) % 2 and self.shapes[shape]:
                tag, names, values, classes, marks, own = self.shapes[shape]
                given = iter(cut[1::2])
                attrs = tuple(zip(names, [value_of(next(given)) if v == SLOT else v for v in values], strict=True))
                self.lists["attrs"].append(attrs)
                return STARTED, (self.kind_of(tag, classes, len(self.lists["attrs"]) - 1), marks, own)
        found = PLAIN.fullmatch(mark)
        if not found:
            return ODD, None
        if found[1]:
            return ENDED, found[1].lower()
        if found[2]:
            return STARTED, self.start_of(found[2].lower(), attributes_of(found[3]))
        return (WHOLE, self.start_of(found[4].lower(), [])) if found[4] else (REMARK, found[5])

    def shape_of(self, shape: str) -> tuple | None:
        """What start tags of a shape say but for their values; None if these say marks, or if the shape is none of a plain start tag."""
        found = PLAIN.fullmatch(shape)
        if not found or not found[2]:
            return None
        tag, attrs = found[2].lower(), attributes_of(found[3])
        named = dict(attrs)
        if len(named) < len(attrs) or SLOT in (named.get("class"), named.get("id")):
            return None
        kind, marks, own = self.start_of(tag, attrs)
        return tag, tuple(named), [v or "" for v in named.values()], self.kinds[kind][1], marks, own

    def kind_of(self, tag: str, classes: int, attrs: int) -> int:
        self.kinds.append((tag, classes, attrs))
        return len(self.kinds) - 1

    def number(self, kind: str, own: tuple) -> int:
        """The number of a list of marks, classes or attributes."""
        at = self.numbers[kind].get(own)
        if at is None:
            at = self.numbers[kind][own] = len(self.lists[kind])
            self.lists[kind].append(own)
        return at

    def start_of(self, tag: str, attrs: list) -> tuple:
        """What a start tag says: the number of its (tag, classes, attributes), its own marks, and their number."""
        named = {k: v or "" for k, v in dict(attrs).items()}
        classes = tuple(named.get("class", "").split())
        marks = (tag, *("." + c for c in classes), *(["#" + named["id"]] if named.get("id") else []))
        return self.kind_of(tag, self.number("classes", classes), self.number("attrs", tuple(named.items()))), marks, self.marks.setdefault(marks, len(self.marks))

    def state_of(self, tags: tuple, inner: tuple) -> int:
        at = self.places.get((tags, inner))
        if at is None:
            at = self.places[tags, inner] = len(self.states)
            self.states.append((tags, inner))
        return at

    def move(self, marks: tuple) -> tuple:
        tag, (tags, inner) = marks[0], self.states[self.state]
        depth = len(tags)
        if tag in ENDS:
            depth = self.left_of(*ENDS[tag])
        elif tag in BLOCKS:
            depth = self.left_of({"p"}, {"td", "th", "li", "table", "div", "section", "article"})
        tags, inner = tags[:depth], inner[:depth]
        around = inner[-1] if inner else 0
        if tag in EMPTY:
            return depth, around, self.state_of(tags, inner), False
        outer = self.lists["around"][around]
        inside = self.number("around", (*outer, *(m for m in marks if m not in outer)))
        return depth, around, self.state_of((*tags, tag), (*inner, inside)), True

    def left_of(self, ended: set, within: set) -> int:
        """How many elements stay open if the outermost of `ended` inside the innermost of `within` is closed."""
        tags = self.states[self.state][0]
        found = len(tags)
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] in within:
                break
            if tags[i] in ended:
                found = i
        return found

    def close_from(self, depth: int) -> None:
        self.shut += self.open[depth:]
        self.last += [len(self.said) - self.base - 1] * (len(self.open) - depth)
        del self.open[depth:], self.paths[depth + 1 :]

    def open_path(self, at: int) -> None:
        self.lists["path"].append((*self.lists["path"][self.paths[-1]], at))
        self.paths.append(len(self.lists["path"]) - 1)

    def node(self, said: int) -> None:
        """Appends a node that has nothing inside yet."""
        self.said.append(said)
        if self.has_paths:
            self.path.append(self.paths[-1])

    def start(self, start: tuple) -> None:
        said, marks, own = start
        key = (self.state, own)
        move = self.moves.get(key)
        if move is None:
            move = self.moves[key] = self.move(marks)
        depth, around, self.state, stays = move
        if len(self.open) > depth:
            self.close_from(depth)
        at = len(self.said)
        self.node(said)
        self.around.append(around)
        if stays:
            self.open.append(at)
            if self.has_paths:
                self.open_path(at - self.base)

    def handle_starttag(self, tag, attrs):
        self.start(self.start_of(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        key = (self.state, tag)
        if key not in self.ends:
            self.ends[key] = self.end_of(tag)
        if self.ends[key]:
            depth, self.state = self.ends[key]
            self.close_from(depth)

    def end_of(self, tag: str) -> tuple | None:
        tags, inner = self.states[self.state]
        limit = tag in ("td", "th", "tr", "p", "li")  # these end inside their own table only
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] == tag:
                return i, self.state_of(tags[:i], inner[:i])
            if limit and tags[i] == "table":
                return None
        return None

    def handle_data(self, data):
        if data and not data.isspace():
            tags = self.states[self.state][0]
            self.node(RAW_LEAF if tags and tags[-1] in UNSEEN else TEXT_LEAF)
            self.text.append(data)

    def handle_comment(self, data):
        self.node(COMMENT_LEAF)
        self.text.append(data)

    def numbered(self) -> tuple[np.ndarray, ...]:
        """Of every node: enter, leave, the number of its kind, whether it is an element, and the number of its marks around."""
        said = np.array(self.said, np.int32)
        first = np.array(self.first, np.int64)
        enter = np.arange(len(said)) - np.repeat(first, np.diff(np.append(first, len(said))))
        leave = enter.copy()
        leave[np.array(self.shut, np.int64)] = self.last
        element = said >= len(LEAVES)
        around = np.zeros(len(said), np.int32)
        around[element] = self.around
        return enter.astype(np.int32), leave.astype(np.int32), said, element, around

    @property
    def nodes(self) -> list[tuple]:
        """The nodes as tuples (enter, leave, path, around, tag, classes, attrs, text)."""
        if not self.said:
            return []
        enter, leave, said, element, around = (x.tolist() for x in self.numbered())
        path, text = [self.lists["path"][i] for i in self.path] if self.has_paths else [None] * len(said), iter(self.text)
        kinds = [self.kinds[k] for k in said]
        return [
            (*x, own, self.lists["around"][a], tag, self.lists["classes"][classes], self.lists["attrs"][attrs], None if is_element else next(text))
            for x, own, a, (tag, classes, attrs), is_element in zip(zip(enter, leave, strict=True), path, around, kinds, element, strict=True)
        ]

    def taken(self) -> list[pa.Array]:
        """The columns as Arrow has them; the pages so far go."""
        enter, leave, said, element, around = self.numbered()
        tag, classes, attrs = zip(*self.kinds, strict=True)
        texts = pa.array(np.cumsum(~element) - 1, pa.int32(), mask=element)
        numbers = {"path": self.path, "around": around, "classes": np.array(classes, np.int32)[said], "attrs": np.array(attrs, np.int32)[said]}
        made = {"enter": pa.array(enter), "leave": pa.array(leave), "tag": pa.array(tag, pa.string()).take(pa.array(said)), "text": pa.array(self.text, pa.string()).take(texts)}
        for name, at in numbers.items():
            kind = FIELDS.field(name).type
            made[name] = pa.array(self.lists[name], kind).take(pa.array(at, pa.int32())) if name != "path" or self.has_paths else pa.nulls(len(said), kind)
        self.clear()
        return [made[f.name] for f in FIELDS]


def value_of(said: str) -> str:
    return unescape_value(said) if "&" in said else said


def attributes_of(said: str) -> list[tuple[str, str]]:
    return [(k.lower(), value_of(a or b or c)) for k, a, b, c in ATTRIBUTES(said)] if said else []


unescape_value = getattr(parser, "_unescape_attrvalue", unescape)  # as HTMLParser reads values, which later versions do by a rule of their own
LEAVES = ((TEXT, 0, 0), (RAW, 0, 0), (COMMENT, 0, 0))
TEXT_LEAF, RAW_LEAF, COMMENT_LEAF = range(len(LEAVES))
FIELDS = pa.schema([("enter", pa.int32()), ("leave", pa.int32()), ("path", pa.list_(pa.int32())), ("around", pa.list_(pa.string())), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


def page_reader(paths: bool = True) -> _Nodes:
    """A reader that has no page yet."""
    reader = _Nodes(paths)
    reader.clear()
    return reader


def read_page(html: str) -> list[tuple]:
    """The nodes of one page."""
    reader = page_reader()
    reader.add(html)
    return reader.nodes


def page_nodes(pages: DataFrame) -> DataFrame:
    """A row per node of every page (page_id, html)."""
    arrow = pa.schema([("page_id", pa.int64()), *FIELDS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, reader = [], page_reader()  # of the pages since the last batch went out: a batch a page would cost more than reading it
        for batch in batches:
            for page, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if html:
                    reader.add(html)
                    owners += [page] * (len(reader.said) - len(owners))
                    if len(owners) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *reader.taken()], schema=arrow)
                        owners = []
        if owners:
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *reader.taken()], schema=arrow)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(rows, SCHEMA)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def page_arrays(pages: DataFrame, *keep: str, paths: bool = False) -> DataFrame:
    """A row per page (page_id, html) with its `nodes`, in order, and the columns <keep>; no row for a null or empty page. Nodes have their path
    only where it is asked for."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), *keep, "html").where("html <> ''")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + [f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ', ')}>>"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = page_reader(paths)
        for batch in batches:
            n, at, ends = batch.num_rows, 0, [0]
            others = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "nodes"]
            for i in range(n):
                reader.add(batch.column("html")[i].as_py())
                ends.append(len(reader.said))
                if ends[-1] >= BATCH or i + 1 == n:
                    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(reader.taken(), fields=list(FIELDS)))
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, i + 1 - at) for c in others), listed], names=names)
                    at, ends = i + 1, [0]

    return own.mapInArrow(rows, schema)


def packed(nodes: DataFrame) -> DataFrame:
    """Nodes as `page_arrays` gives them, from there or from a node table."""
    if "nodes" in nodes.columns:
        return nodes
    listed = F.collect_list(F.struct(*[f.name for f in FIELDS]))
    return nodes.groupBy("page_id").agg(F.array_sort(listed, lambda a, b: a["enter"] - b["enter"]).alias("nodes"))


def let(c: Column, say: Callable) -> Column:
    """say(c), with c made once."""
    return F.get(F.transform(F.array(c), say), F.lit(0))


def with_url(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """`packed` nodes with their page's url, from `pages` where they do not have it."""
    rows = packed(nodes)
    return rows if "url" in rows.columns else rows.join(pages.select("page_id", "url"), "page_id")


def of_page(where: Callable) -> Column:
    """The page's elements that `where` selects."""
    return F.filter("nodes", where)


def inside(x: Column, where: Callable) -> Column:
    """The nodes inside an element that `where` selects; none for null."""
    return F.filter(F.slice("nodes", x["enter"] + 2, x["leave"] - x["enter"]), where)


def innermost(x: Column, tag: str) -> Column:
    """The place of the innermost element of this tag around x, or null."""
    return F.try_element_at(F.filter(x["path"], lambda at: is_tag(tag, of=F.get("nodes", at))), F.lit(-1))


def head(found: Column) -> Column:
    """The first of the elements found, or null."""
    return F.get(found, F.lit(0))


def pieces_in(x: Column) -> Column:
    """The texts inside an element, in order, white space as one blank, without the blank ones."""
    said = F.transform(inside(x, lambda n: is_tag(TEXT, of=n)), lambda n: F.trim(F.regexp_replace(n["text"], r"[\s ]+", " ")))
    return F.filter(said, lambda t: t != "")


def text_of(x: Column) -> Column:
    """The text inside an element as `texts` gives it; '' for null."""
    return F.coalesce(let(x, lambda n: F.array_join(pieces_in(n), " ")), F.lit(""))


def field(x: Column, where: Callable) -> Column:
    """The text of the first element inside x that `where` selects, or ''."""
    return text_of(head(inside(x, where)))


def each(nodes: DataFrame, found: Column) -> DataFrame:
    """page_id and the fields of every struct of an array that is made from a page's `nodes`."""
    return packed(nodes).select("page_id", F.explode(found).alias("_one")).select("page_id", "_one.*")


def settled_nodes(pages: DataFrame) -> DataFrame:
    """The node table of pages, made once, in buckets of pages: no selection over it moves nodes between tasks."""
    return settle_by(page_nodes(dealt(pages.select("page_id", "html"), "page_id")), "page_id", is_dealt=True)


def _of(x: Column | None, name: str) -> Column:
    return F.col(name) if x is None else x[name]


def attr(name: str, of: Column | None = None) -> Column:
    return F.coalesce(F.try_element_at(_of(of, "attrs"), F.lit(name)), F.lit(""))


def has_attr(name: str, of: Column | None = None) -> Column:
    return F.map_contains_key(_of(of, "attrs"), name)


def has_class(*names: str, of: Column | None = None) -> Column:
    """Whether an element has one of these classes."""
    return reduce(Column.__or__, [F.array_contains(_of(of, "classes"), n) for n in names])


def is_tag(*tags: str, of: Column | None = None) -> Column:
    return reduce(Column.__or__, [_of(of, "tag") == t for t in tags])


def within(*marks: str, of: Column | None = None) -> Column:
    """Whether an ancestor has one of these tags, .classes or #ids."""
    return reduce(Column.__or__, [F.array_contains(_of(of, "around"), m) for m in marks])


def chosen(nodes: DataFrame, where: Column, name: str, /, **columns: Column) -> DataFrame:
    """page_id, <name> (the element's place) and further columns of the elements that `where` selects."""
    return nodes.where(where).select("page_id", F.col("enter").alias(name), *[c.alias(k) for k, c in columns.items()])


def under(nodes: DataFrame, where: Column, outer: DataFrame, name: str, inner: str, /, **columns: Column) -> DataFrame:
    """The elements that `where` selects inside each outer element (page_id, <name>, ...): outer's columns, <inner> and further columns."""
    met = nodes.where(where).select("page_id", "path", F.col("enter").alias(inner), *[c.alias(k) for k, c in columns.items()])  # once a node, not once an ancestor
    return outer.join(met.select("page_id", F.explode("path").alias(name), inner, *columns), ["page_id", name])


def first(found: DataFrame, keys: list[str], inner: str, *columns: str, last: bool = False) -> DataFrame:
    """Of the elements under one key the first (or last) in the page's order."""
    pick = F.max_by if last else F.min_by
    kept = found.groupBy(*keys).agg(pick(F.struct(inner, *columns), inner).alias("_one"))
    return kept.select(*keys, *[F.col(f"_one.{c}").alias(c) for c in (inner, *columns)])


def texts(nodes: DataFrame, of: DataFrame, name: str, text: str = "text") -> DataFrame:
    """`of` with the text inside each of its elements <name>: the texts in order, one blank between, white space as one blank; else ''."""
    said = nodes.where(is_tag(TEXT)).select("page_id", "path", "enter", "tag", F.trim(F.regexp_replace("text", r"[\s ]+", " ")).alias("_text")).where("_text <> ''")
    inner = under(said, is_tag(TEXT), of.select("page_id", name).distinct(), name, "_at", _text=F.col("_text"))
    said = inner.groupBy("page_id", name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), " ").alias(text))
    return of.join(said, ["page_id", name], "left").withColumn(text, F.coalesce(text, F.lit("")))


def fields(nodes: DataFrame, of: DataFrame, name: str, /, **where: Column) -> DataFrame:
    """`of` with a column for each condition: the text of the first element under <name> that meets it, or ''. All are found in one pass."""
    met = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in where.items()]), lambda x: x.isNotNull())
    marked = nodes.select("page_id", "enter", "path", F.explode(met).alias("_field"))
    found = marked.select("page_id", F.explode("path").alias(name), "enter", "_field").join(of.select("page_id", name).distinct(), ["page_id", name])
    firsts = found.groupBy("page_id", name, "_field").agg(F.min("enter").alias("_first"))
    said = texts(nodes, firsts, "_first", "_said").groupBy("page_id", name).agg(*[F.max(F.when(F.col("_field") == k, F.col("_said"))).alias(k) for k in where])
    return of.join(said, ["page_id", name], "left").withColumns({k: F.coalesce(k, F.lit("")) for k in where})


def nearest(nodes: DataFrame, of: DataFrame, name: str, where: Column, outer: str) -> DataFrame:
    """`of` with <outer>: the innermost element that `where` selects around each element <name> (null if there is none)."""
    paths = of.select("page_id", name).distinct().join(nodes.select("page_id", F.col("enter").alias(name), "path"), ["page_id", name])
    around = paths.select("page_id", name, F.explode("path").alias(outer)).join(chosen(nodes, where, outer), ["page_id", outer])
    return of.join(around.groupBy("page_id", name).agg(F.max(outer).alias(outer)), ["page_id", name], "left")


def outermost(nodes: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """Those of the elements <name> that have none of them around."""
    own = of.select("page_id", name).distinct()
    paths = own.join(nodes.select("page_id", F.col("enter").alias(name), "path"), ["page_id", name])
    around = paths.select("page_id", F.col(name).alias("_inner"), F.explode("path").alias(name)).join(own, ["page_id", name])
    return of.join(around.select("page_id", F.col("_inner").alias(name)).distinct(), ["page_id", name], "left_anti")
