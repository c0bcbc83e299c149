"""Review-page field extraction.

Fields sit in elements found by tag and class, and an element reaches to its
own end tag however deep its contents are nested, which regular expressions
cannot follow; so each page is read once by the standard library's event
parser inside an Arrow batch. Character references (named and numeric) are
decoded and attributes may be quoted either way or not at all.

A field's text follows the "strip every text node and concatenate" rule; a
paragraph runs from one ``<p>`` to the next ``<p>`` or ``</p>``; the
paragraphs of the text block are joined by one space. A missing block gives
null, as does a null page. Scripts, styles and comments hold no text."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Classes of the blocks of a review page, and its full stars.
BLOCKS = ("published", "author", "rating", "text")
STAR = "star-black.png"
# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class ReviewPage(HTMLParser):
    """Collects the first ``h1`` and the first ``div`` of each class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: dict[str, int] = {}  # block -> depth of its tag since it began
        self.done: set[str] = set()
        self.parts: dict[str, list[str]] = {}
        self.stars: int | None = None
        self.paragraphs: list[list[str]] | None = None
        self.in_paragraph = False
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "h1":
            self._begin("h1", "h1")
        if tag == "div":
            classes = next(((v or "").split() for k, v in attrs if k == "class"), [])
            for name in BLOCKS:
                if name in classes:
                    self._begin(name, "div")
        for name in self.open:
            if tag == ("h1" if name == "h1" else "div"):
                self.open[name] += 1
        if tag == "img" and "rating" in self.open and any(k == "src" and STAR in (v or "") for k, v in attrs):
            self.stars += 1
        if tag == "p" and "text" in self.open:
            self.in_paragraph = True
            self.paragraphs.append([])

    def _begin(self, name, tag):
        if name in self.done or name in self.open:
            return
        self.open[name] = 0
        self.parts[name] = []
        if name == "rating":
            self.stars = 0
        if name == "text":
            self.paragraphs = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag == "p":
            self.in_paragraph = False
        for name in [n for n in self.open if tag == ("h1" if n == "h1" else "div")]:
            self.open[name] -= 1
            if self.open[name] <= 0:
                del self.open[name]
                self.done.add(name)
                if name == "text":
                    self.in_paragraph = False

    def handle_data(self, data):
        text = data.strip()
        if not text or self.silent:
            return
        for name in self.open:
            self.parts[name].append(text)
        if self.in_paragraph and "text" in self.open:
            self.paragraphs[-1].append(text)

    def field(self, name):
        return "".join(self.parts[name]) if name in self.parts else None


def review_fields(page: str | None) -> tuple:
    """(Title, Date, Author, Rating, Review) of one page."""
    if page is None:
        return (None,) * 5
    r = ReviewPage()
    r.feed(page)
    r.close()
    review = None if r.paragraphs is None else " ".join("".join(p) for p in r.paragraphs)
    return r.field("h1"), r.field("published"), r.field("author"), r.stars, review


def scrape_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages -> raw review rows (Title, URL, Author, Date, Rating, Review),
    with the other columns of ``pages`` (replaced if of those names)."""
    new = ["Title", "URL", "Author", "Date", "Rating", "Review"]
    keep = [c for c in pages.columns if c not in (html_col, url_col, *new)]

    def run(batches):
        for b in small_batches(batches, len(keep) + 1):
            rows = [review_fields(p) for p in b.column(len(keep) + 1).to_pylist()]
            title, date, author, rating, review = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 5
            made = [pa.array(title, pa.string()), b.column(len(keep)), pa.array(author, pa.string()), pa.array(date, pa.string()),
                    pa.array(rating, pa.int32()), pa.array(review, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *made], names=[*keep, *new])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    made = "Title string, URL string, Author string, Date string, Rating int, Review string"
    return pages.select(*keep, F.col(url_col), F.col(html_col)).mapInArrow(run, ", ".join([*types, made]))
