"""Records from HTML pages and blocks of text, as table functions over a column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.blank import blank_to_null

#: Patterns of contact fields, shared by all extractions.
PHONE = r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]\d{4}"
ADDRESS = r"\d+\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Dr|Drive|Ln|Lane|Pike|Hwy)\b"
SKIPPED = {"nav", "footer", "script", "style", "header"}
# Headings that name a part of a page, not a place.
PARTS = {"find food", "resources", "about", "contact", "home", "menu", "services", "programs", "volunteer", "donate"}


class _Blocks(HTMLParser):
    """The page's headings, paragraphs, list items and table rows in order, without navigation."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.skip, self.kind, self.held = 0, None, []

    def close_block(self):
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if self.kind and text:
            self.blocks.append((self.kind, text))
        self.kind, self.held = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.close_block()
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4"):
            self.close_block()
            self.kind = "heading"
        elif tag in ("p", "div", "address"):
            self.close_block()
            self.kind = "text"
        elif tag == "li":
            self.close_block()
            self.kind = "item"
        elif tag == "tr":
            self.close_block()
            self.kind = "row"
        elif tag in ("td", "th", "br"):
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3", "h4", "p", "div", "address", "li", "tr", "ul", "ol", "table"):
            self.close_block()

    def handle_data(self, data):
        if not self.skip and self.kind:
            self.held.append(data)


@udtf(returnType="strategy string, name string, text string, phone string, address string, zip string")
class extract_records:
    """Records of a page by three strategies: a heading with the texts after it (``siblings`` at most; headings that name
    a part of the page give none), table rows, and list items of 15 to 400 characters. The last two need a telephone
    number or an address."""

    def eval(self, html: str, siblings: int) -> Iterator[tuple]:
        if not html:
            return
        parser = _Blocks()
        parser.feed(html)
        parser.close_block()
        blocks = parser.blocks
        for k, (kind, text) in enumerate(blocks):
            if kind == "heading" and 3 <= len(text) <= 150 and text.lower() not in PARTS:
                following = []
                for other, more in blocks[k + 1 : k + 1 + siblings]:
                    if other == "heading":
                        break
                    following.append(more)
                yield self.record("heading", text, " | ".join([text, *following]))
            elif kind == "row" or (kind == "item" and 15 <= len(text) <= 400):
                found = self.record("table" if kind == "row" else "list", text[:80], text)
                if found[3] or found[4]:
                    yield found

    @staticmethod
    def record(strategy: str, name: str, text: str) -> tuple:
        phone, address, zips = re.search(PHONE, text), re.search(ADDRESS, text), re.findall(r"\b\d{5}\b", text)
        return strategy, name, text, phone and phone.group(), address and address.group(), zips[-1] if zips else None


def page_records(pages: DataFrame, key: str = "page_id", html: str = "html", siblings: int = 5) -> DataFrame:
    """The records of every page, with the page's key. ``siblings``: blocks that may follow a heading, by the site."""
    return pages.select(key, html).lateralJoin(extract_records(F.col(html).outer(), F.lit(siblings))).drop(html)


def tagged_field(card: Column, name: str) -> Column:
    """The text of a card's element whose ``data-name`` is ``name``; null if it has none or says ``none``."""
    inner = F.regexp_extract(card, rf'(?s)<([a-z0-9]+)\b[^>]*\bdata-name="{re.escape(name)}"[^>]*>(.*?)</\1>', 2)
    text = F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]*>", " "), r"\s+", " "))
    return F.when((text != "") & (F.lower(text) != "none"), text)


def tagged_link(card: Column, name: str) -> Column:
    """The first link inside such an element, if it is one of the web."""
    link = F.regexp_extract(card, rf'(?s)\bdata-name="{re.escape(name)}"(?:(?!data-name=).)*?<a\b[^>]*?\bhref="(https?[^"]*)"', 1)
    return F.when(link != "", link)


def in_states(address: Column, states: list[str]) -> Column:
    """Whether an address ends its city with one of the states and a postal code."""
    return F.coalesce(address.rlike(rf",\s*(?:{'|'.join(map(re.escape, states))})\s+\d{{5}}"), F.lit(False))


def page_chain(records: DataFrame, site: str, page: str, name: str, order: str, cap: int) -> DataFrame:
    """The records that reading a site's pages in turn keeps: the first of each name, from at most ``cap`` pages (numbered
    from 1), as far as the last page before one that adds no name. A page that is missing ends the site as well."""
    rows = records.where(F.col(page).between(1, cap) & F.col(name).isNotNull())
    first = rows.groupBy(site, name).agg(F.min(F.struct(page, order)).alias("__first"))
    adding = first.groupBy(site).agg(F.array_sort(F.collect_set(F.col(f"__first.{page}").cast("long"))).alias("__pages"))  # at most cap numbers
    reached = adding.select(site, F.size(F.filter("__pages", lambda p, k: p == k + 1)).alias("__last"))
    kept = first.join(reached, site).where(F.col(f"__first.{page}") <= F.col("__last"))
    kept = kept.select(site, name, F.col(f"__first.{page}").alias(page), F.col(f"__first.{order}").alias(order))
    return records.join(kept, [site, name, page, order], "left_semi")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]+)"'), F.lit(1))


def text_blocks(text: Column) -> Column:
    """A document's blocks between blank lines, without page numbers.

    ``F.trim`` itself would be given the block's number too, as the character to trim.
    """
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(b)), lambda b: (b != "") & ~b.rlike(r"^(?i:page )?\d+$"))


def block_records(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block, name, text, phone, address, zip`` of the blocks of each text that tell of a place.

    A block's name is its first line, of 3 to 150 letters; it needs a telephone number, an address or a postal code.
    Blocks are numbered from 0 as they stand in the text, page numbers left out.
    """
    rows = texts.select(key, F.posexplode(text_blocks(F.col(text))).alias("block", "__block"))
    lines = F.filter(F.transform(F.split("__block", "\n"), lambda line: F.trim(line)), lambda line: line != "")
    rows = rows.select(key, "block", F.get(lines, F.lit(0)).alias("name"), F.array_join(lines, " ").alias("text"))
    zips = blank_to_null(F.regexp_extract("text", r"(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)", 1))
    rows = rows.withColumns({"phone": blank_to_null(F.regexp_extract("text", PHONE, 0)), "address": blank_to_null(F.regexp_extract("text", ADDRESS, 0)), "zip": zips})
    return rows.where(F.length("name").between(3, 150) & F.coalesce("phone", "address", "zip").isNotNull())


def wide_hours(days: dict[str, Column]) -> Column:
    """``Mon: …, Tue: …`` of a column for each day; line breaks become semicolons."""
    return F.concat_ws(", ", *[F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{d}: "), F.regexp_replace(c, r"\r\n|\n", "; "))) for d, c in days.items()])
