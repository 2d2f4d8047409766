"""HTML to title and text in Arrow batches: one scan yields marks, nesting decides what shows, lines are put together last."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without text, and those that begin or end a line.
SKIPPED = {"script", "style", "noscript", "svg"}
LINE_BEGINS = {"p", "br", "li", "tr", "h1", "h2", "h3", "section", "article"}
LINE_ENDS = {"p", "li", "tr", "h1", "h2", "h3"}

#: A comment or declaration, an end tag, a start tag, or a run of text (a lone ``<`` is one of its own).
MARK = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | </(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z) | </[^>]*(?:>|\Z)
    | <(?P<start>[a-z][^\s/>]*) (?:"[^"]*" | '[^']*' | /(?!>) | [^'">/])*+ (?:(?P<closed>/)> | >)
    | (?P<run>[^<]+ | <)""",
    re.S | re.I | re.X,
)
#: Behind the last ``>`` no tag ends: a comment or declaration takes the rest.
LONE = re.compile("<[!?].*|(?P<run><)", re.S)


def marks(html: str) -> Iterator[tuple[str, str]]:
    """(kind, value) in order: ``start`` and ``end`` with an element's name, ``run`` with text. An element closed in its own
    start tag gives both; what a script or style holds is passed over up to its end tag."""
    at, last = 0, html.rfind(">")
    while at < len(html):
        m = MARK.match(html, at) if at <= last or html[at] != "<" else LONE.match(html, at)
        kind, at = m.lastgroup, m.end()
        if kind == "run" or kind is None:
            if kind:
                yield "run", m["run"]
            continue
        name = (m["end"] or m["start"]).lower()
        yield ("end" if m["end"] else "start"), name
        if m["closed"]:
            yield "end", name
        elif m["start"] and name in ("script", "style"):
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            at = close.start() if close else len(html)


def shown(events: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """("line", "") where a line breaks, else ("text" or "title", run). Nothing shows inside elements without text, of which
    an end tag closes the innermost alone; lines break there too."""
    inside: list[str] = []
    kind = "text"
    for event, value in events:
        if event == "run":
            if not inside and value.strip():
                yield kind, value
            continue
        if value in SKIPPED and (event == "start" or inside[-1:] == [value]):
            inside = [*inside, value] if event == "start" else inside[:-1]
        if value == "title":
            kind = "title" if event == "start" else "text"
        if value in (LINE_BEGINS if event == "start" else LINE_ENDS):
            yield "line", ""


def page_text(html: str | None) -> tuple[str, str]:
    """Title and text: runs of text joined by blanks, blanks squeezed, line breaks where LINE_BEGINS and LINE_ENDS have them,
    character references resolved (also ones that were written twice). The title is part of the text."""
    runs = [(kind, unescape(value).strip()) for kind, value in shown(marks(html or ""))]
    lines = [" ".join(value for _, value in own) for breaks, own in groupby(runs, lambda r: r[0] == "line") if not breaks]
    text = re.sub(r"[ \t\r\f\v]+", " ", unescape(" \n".join(lines)))
    return "".join(value for kind, value in runs if kind == "title"), re.sub(r"\n\s+", "\n", text).strip()


def texts(pages: DataFrame) -> DataFrame:
    """page_id, title, text. pages: page_id (long), html (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, found = zip(*(page_text(x.as_py()) for x in b.column(1)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(titles, pa.string()), pa.array(found, pa.string())], ["page_id", "title", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, title string, text string")
