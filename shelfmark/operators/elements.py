"""Raw pages to one row of elements per page.

The page is parsed once by a narrow Arrow job; every later question about it is
a row-local expression (see matching.py). Text is held once per page, as the
ordered text pieces in ``runs``; an element names its slice of them, so nested
elements do not repeat their text and a page stays linear in its source size.
``ink`` counts the characters of that text that are not white space.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the parser with the task, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tags without content, subtrees that are not content, tags that
# hold only text, list tags, and tags whose start ends an open paragraph.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED_TAGS = frozenset("script style iframe noscript".split())
PLAIN_TAGS = frozenset(("title", "textarea"))
LIST_TAGS = frozenset(("ul", "ol"))
PARAGRAPH_ENDERS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
# Attributes the extraction operators read, for jobs that need no others.
DEFAULT_ATTRS = ("href", "src", "alt", "name", "content", "width", "height")

ELEMENT = (
    "struct<pos:int,parent_pos:int,last_pos:int,tag:string,classes:array<string>,attrs:map<string,string>,"
    "run_from:int,run_to:int,ink:int>"
)
ELEMENTS_COLUMNS = f"runs array<string>, elements array<{ELEMENT}>, parse_error string"

# A result batch is handed over once it holds this many elements.
_FLUSH_ELEMENTS = 50_000


# Tags and comments; quotes hide ">" only in attribute values. What is open at
# the end of the page runs to the end.
_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|/([a-zA-Z][^\s/>]*)[^>]*>?|/[^>]*>?
    |([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+)(?:>|\Z))""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_END_OF = {tag: re.compile(rf"</{tag}[\s/>]|\Z", re.I) for tag in DROPPED_TAGS | PLAIN_TAGS}


def _decoded(text: str) -> str:
    return unescape(text) if "&" in text else text


class _Columns:
    """Flat column buffers for a batch of parsed pages."""

    def __init__(self, wanted: frozenset[str] | None) -> None:
        self.wanted = wanted
        self.errors: list[str | None] = []
        self.run_ends, self.element_ends = [0], [0]
        self.parent, self.last, self.tags, self.run_from, self.run_to, self.ink = [], [], [], [], [], []
        self.class_ends, self.classes = [0], []
        self.attr_ends, self.keys, self.values = [0], [], []
        self.runs = []

    def add(self, html: str | None) -> None:
        grown = (self.parent, self.last, self.tags, self.run_from, self.run_to, self.ink, self.class_ends, self.classes,
                 self.attr_ends, self.keys, self.values, self.runs)
        before, error = [len(column) for column in grown], None
        try:
            self._parse(html or "")
        except Exception as problem:  # one bad page must not stop the job
            error = f"{type(problem).__name__}: {problem}"
            for column, length in zip(grown, before):
                del column[length:]
        self.errors.append(error)
        self.run_ends.append(len(self.runs))
        self.element_ends.append(len(self.tags))

    def _parse(self, html: str) -> None:
        """Append the elements and text pieces of one page, in page order.

        Void tags end themselves; a new paragraph, block or list item ends the
        paragraph or item that is open; the end of the page ends everything.
        """
        first, first_run = len(self.tags), len(self.runs)
        opened: list[int] = []
        counts: Counter[str] = Counter()
        items, lists = [-1], [-1]
        at, length, ink = 0, len(html), 0

        def read(raw: str) -> int:
            text = _decoded(raw)
            self.runs.append(text)
            return sum(map(len, text.split()))

        def close(tag: str | None) -> None:
            while opened:
                index = opened.pop()
                closed = self.tags[index]
                counts[closed] -= 1
                self.last[index] = len(self.tags) - 1 - first
                self.run_to[index] = len(self.runs) - first_run
                self.ink[index] = ink - self.ink[index]
                if closed == "li":
                    items.pop()
                elif closed in LIST_TAGS:
                    lists.pop()
                if closed == tag:
                    return

        while at < length:
            token = _TOKEN.search(html, at)
            start = token.start() if token else length
            if start > at:
                ink += read(html[at:start])
            if token is None:
                break
            at = token.end()
            ended, tag, attrs = token.groups()
            if ended:
                ended = ended.lower()
                if counts[ended]:
                    close(ended)
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag in DROPPED_TAGS:
                found = _END_OF[tag].search(html, at)
                # Continue inside the end tag, which then ends nothing.
                at = found.start()
                continue
            if tag in PARAGRAPH_ENDERS:
                if counts["p"]:
                    close("p")
            elif tag == "li" and items[-1] > lists[-1]:
                close("li")
            index = len(self.tags)
            self.parent.append(opened[-1] - first if opened else -1)
            self.last.append(index - first)
            self.tags.append(tag)
            self.run_from.append(len(self.runs) - first_run)
            self.run_to.append(len(self.runs) - first_run)
            self.ink.append(0 if tag in VOID_TAGS else ink)
            if attrs:
                self._attributes(attrs)
            self.class_ends.append(len(self.classes))
            self.attr_ends.append(len(self.keys))
            if tag in VOID_TAGS:
                continue
            opened.append(index)
            counts[tag] += 1
            if tag == "li":
                items.append(index)
            elif tag in LIST_TAGS:
                lists.append(index)
            elif tag in PLAIN_TAGS:
                end = _END_OF[tag].search(html, at).start()
                if end > at:
                    ink += read(html[at:end])
                at = end
        close(None)

    def _attributes(self, text: str) -> None:
        seen = set()
        for key, double, single, bare in _ATTR.findall(text):
            key = key.lower()
            if key in seen:
                continue
            seen.add(key)
            value = _decoded(double or single or bare)
            if key == "class":
                self.classes += value.split()
            elif self.wanted is None or key in self.wanted:
                self.keys.append(key)
                self.values.append(value)

    def arrays(self) -> list[pa.Array]:
        i32, text = pa.int32(), pa.string()

        def ends(values):
            return pa.array(values, i32)

        pages = zip(self.element_ends, self.element_ends[1:])
        positions = pa.array([i for start, end in pages for i in range(end - start)], i32)
        element = pa.StructArray.from_arrays(
            [
                positions, pa.array(self.parent, i32), pa.array(self.last, i32),
                pa.array(self.tags, text),
                pa.ListArray.from_arrays(ends(self.class_ends), pa.array(self.classes, text)),
                pa.MapArray.from_arrays(ends(self.attr_ends), pa.array(self.keys, text), pa.array(self.values, text)),
                pa.array(self.run_from, i32), pa.array(self.run_to, i32), pa.array(self.ink, i32),
            ],
            names=["pos", "parent_pos", "last_pos", "tag", "classes", "attrs", "run_from", "run_to", "ink"],
        )
        return [
            pa.ListArray.from_arrays(ends(self.run_ends), pa.array(self.runs, text)),
            pa.ListArray.from_arrays(ends(self.element_ends), element),
            pa.array(self.errors, text),
        ]


def _parser(kept: list[str], wanted: frozenset[str] | None):
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            start, columns = 0, _Columns(wanted)
            for row in range(batch.num_rows):
                columns.add(html[row].as_py())
                if len(columns.tags) >= _FLUSH_ELEMENTS or row == batch.num_rows - 1:
                    carried = [batch.column(name).slice(start, row + 1 - start) for name in kept]
                    yield pa.RecordBatch.from_arrays(
                        carried + columns.arrays(), names=[*kept, "runs", "elements", "parse_error"]
                    )
                    start, columns = row + 1, _Columns(wanted)

    return parse


def parse_pages(pages: DataFrame, attrs: Iterable[str] | None = None,
                keep: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus ``runs, elements, parse_error`` for each page.

    ``attrs`` names the attributes to carry, None carries all. A page that
    cannot be parsed gives no elements and the reason in ``parse_error``.
    """
    kept = list(keep)
    source = pages.select(*kept, "html")
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema)
    wanted = None if attrs is None else frozenset(attrs)
    return source.mapInArrow(_parser(kept, wanted), f"{carried}, {ELEMENTS_COLUMNS}")


def explode_elements(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per element, where rows are wanted."""
    text = F.array_join(F.slice("runs", F.col("e.run_from") + 1, F.col("e.run_to") - F.col("e.run_from")), "")
    return parsed.select(*keys, "runs", F.explode("elements").alias("e")).select(
        *keys, "e.pos", "e.parent_pos", "e.last_pos", "e.tag", "e.classes", "e.attrs", text.alias("text")
    )


class HtmlElements:
    """Table function: elements of one page as rows, for SQL with LATERAL."""

    def eval(self, html: str):
        page = _Columns(None)
        page.add(html)
        for pos, tag in enumerate(page.tags):
            attrs = slice(page.attr_ends[pos], page.attr_ends[pos + 1])
            yield (
                pos, page.parent[pos], page.last[pos], tag,
                page.classes[page.class_ends[pos]:page.class_ends[pos + 1]],
                dict(zip(page.keys[attrs], page.values[attrs])),
                "".join(page.runs[page.run_from[pos]:page.run_to[pos]]),
            )


def register_html_elements(spark: SparkSession, name: str = "html_elements") -> None:
    """Make ``SELECT ... FROM pages, LATERAL html_elements(html)`` available."""
    returns = (
        "pos int, parent_pos int, last_pos int, tag string, classes array<string>, attrs map<string,string>, "
        "text string"
    )
    spark.udtf.register(name, F.udtf(HtmlElements, returnType=returns, useArrow=True))
