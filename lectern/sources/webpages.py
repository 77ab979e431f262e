"""HTML pages as text blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the conversion.
SKIPPED = frozenset("script style nav svg form noscript iframe object embed audio video "
                    "canvas picture button select textarea template".split())
SPACED = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd article section header footer "
                   "main aside blockquote pre table tr td th figure figcaption address".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea iframe noscript template".split())
HEAD = frozenset(("head", "title"))
SCENE_BREAK = "* * *"
BORDER = "\u0001"


class _Body(HTMLParser):
    """Readable text of the body with ``BORDER`` between blocks.

    Without a body tag everything but the head is the body. What follows a skipped
    tag that is never closed is kept, unless the tag's content is not text at all.
    """

    def __init__(self, inside: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside = inside
        self.skipped = SKIPPED | HEAD if inside else SKIPPED
        self.skipping: list[tuple[str, int]] = []  # open skipped tags, and where they began

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.inside = True
        elif tag in self.skipped:
            if tag not in VOID:
                self.skipping.append((tag, len(self.parts)))
        elif not self.inside:
            return
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "hr":
            self.parts.append(f"{BORDER}{SCENE_BREAK}{BORDER}")
        elif tag in SPACED:
            self.parts.append(f"{BORDER}- " if tag == "li" else BORDER)

    def handle_startendtag(self, tag, attrs):
        if tag not in self.skipped:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        names = [name for name, _ in self.skipping]
        if tag in names:
            place = names.index(tag)
            del self.parts[self.skipping[place][1]:]
            del self.skipping[place:]
        elif tag in SPACED and self.inside:
            self.parts.append(BORDER)

    def finish(self) -> None:
        """Drops the content of raw tags that stay open; other such content is kept."""
        for name, start in self.skipping:
            if name in RAW:
                del self.parts[start:]
                break

    def handle_data(self, data):
        if self.inside:
            # Line ends of the source are plain space; only <br> makes a line.
            self.parts.append(" ".join(data.replace(BORDER, "").split("\n")))


def page_text(html: str) -> list[str]:
    reader = _Body(inside=not re.search("<body[\\s>]", html, re.IGNORECASE))
    reader.feed(html)
    reader.close()
    reader.finish()
    blocks = []
    for piece in "".join(reader.parts).split(BORDER):
        lines = [" ".join(line.split()) for line in piece.split("\n")]
        text = "\n".join(line for line in lines if line)
        if text:
            blocks.append(text)
    return blocks


def page_texts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: ``blocks`` and the warning ``EMPTY_BODY`` or the empty string."""
    kind = pages.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                key: batch[key], "blocks": [page_text(text or "") for text in batch[html]]})

    return pages.select(key, html).mapInPandas(
        convert, f"`{key}` {kind}, blocks array<string>",
    ).withColumn("warning", F.when(F.size("blocks") == 0, "EMPTY_BODY").otherwise(""))


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return page_texts(pages, key, html).select(
        key, F.posexplode("blocks").alias("block_no", "text"))
