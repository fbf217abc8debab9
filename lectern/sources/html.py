"""HTML pages as blocks."""

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements that start a block of their own (fixed values).
_BLOCK = frozenset("p div section article main header footer nav aside li ul ol dl dt dd blockquote pre figure figcaption form fieldset address body center details summary".split())
_DROPPED = frozenset("script style noscript template head title".split())
#: Numeric references in 0x80-0x9F stand for Windows characters; a browser reads them so.
SPAN_CAP = 200


class _Reader(HTMLParser):
    """Collects (kind, level, text, rows, rel_path); a table takes what stands in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.skip, self.level = [], [], 0, 0
        self.rows, self.cells, self.depth, self.header = None, None, 0, False
        self.links, self.markers = [], []

    def flush(self, kind="para"):
        t = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if t:
            self.blocks.append(("heading" if self.level else kind, self.level or None, t, None, None, None))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _DROPPED:
            self.skip += 1
        if self.skip:
            return
        if tag == "table":
            if self.depth == 0:
                self.flush()
                self.rows, self.header = [], False
            self.depth += 1
        elif self.depth:
            if tag == "tr" and self.depth == 1:
                self.rows.append([])
            elif tag in ("td", "th") and self.depth == 1:
                if not self.rows:
                    self.rows.append([])
                n = lambda k: min(SPAN_CAP, max(1, int(a[k]))) if (a.get(k) or "").strip().isdigit() else 1
                self.header |= tag == "th" and len(self.rows) == 1
                self.rows[-1].append([[], n("colspan"), n("rowspan")])
            elif tag == "br":
                self.handle_data("\n")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.level = int(tag[1])
        elif tag in _BLOCK:
            self.flush()
            if tag == "li":
                self.text.append("- ")
        elif tag == "br":
            self.text.append(" ")
        elif tag == "img" and (src := a.get("src")):
            self.flush()
            if not re.match(r"(?i)https?:|//", src):
                self.blocks.append(("image", None, a.get("alt") or "", None, None, "data:" if src.startswith("data:") else src))
        elif tag in ("b", "strong", "i", "em"):
            self.text.append("**" if tag in ("b", "strong") else "*")
        elif tag == "a":
            self.links.append((len(self.text), a.get("href") or ""))

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        if self.skip:
            return
        if tag == "table" and self.depth:
            self.depth -= 1
            if self.depth == 0:
                rows = grid(self.rows)
                if rows:
                    self.blocks.append(("table", None, None, rows, self.header, None))
                self.rows = None
        elif self.depth:
            pass
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.level = 0
        elif tag in _BLOCK:
            self.flush()
        elif tag in ("b", "strong", "i", "em"):
            self.text.append("**" if tag in ("b", "strong") else "*")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            if at <= len(self.text) and re.match(r"(?i)https?:|mailto:", href):
                shown = "".join(self.text[at:])
                self.text[at:] = [f"[{shown}]({href})"] if shown.strip() else []

    def handle_data(self, data):
        if self.skip:
            return
        if self.depth:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1][0].append(data)
        else:
            self.text.append(data)


def grid(rows) -> list[list[str]]:
    """Rectangular cells: spanned places repeat their cell's text; blank rows go."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for parts, wide, high in row:
            while (r, c) in taken:
                c += 1
            text = re.sub(r"[ \t\r\f\v]+", " ", "".join(parts)).strip()
            for y in range(r, min(r + high, len(rows))):
                for x in range(c, c + wide):
                    taken[y, x] = text
            c += wide
    width = max((x + 1 for _, x in taken), default=0)
    out = [[taken.get((r, x), "") for x in range(width)] for r in range(len(rows))]
    return [r for r in out if any(c.strip() for c in r)]


def read_blocks(html: str) -> list[tuple]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def html_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, level, text, rows, has_header, rel_path) of (doc_id, html) in page order; null pages have none."""

    @pandas_udf("array<struct<kind string, level int, text string, rows array<array<string>>, has_header boolean, rel_path string>>")
    def of(values: pd.Series) -> pd.Series:
        names = ("kind", "level", "text", "rows", "has_header", "rel_path")
        return values.map(lambda h: [dict(zip(names, b)) for b in read_blocks(h or "")])

    return pages.select("doc_id", F.posexplode(of("html")).alias("pos", "b")).select("doc_id", "pos", "b.*")


def visible_texts(html: Column) -> Column:
    """Text between tags, without comments, scripts, styles and the head; blanks go. Character references stay as they are."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|head)\b[^>]*>.*?</\1\s*>", "\n<>\n")
    return F.filter(F.transform(F.split(t, r"<[^>]*>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def links(html: Column) -> Column:
    """href values of anchors in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


@pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Character references decoded; numeric ones in 0x80-0x9F as Windows characters."""
    return values.map(lambda t: None if t is None else unescape(t))


def declared_charset(content: Column) -> Column:
    """The charset that the first 4096 bytes of a page name; empty if none."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_-]+)""", 1))
