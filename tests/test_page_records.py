"""The records of all given pages against a plain reading of their tags."""

import html
import re

from tessera.plans import catalogue
from tessera.sources import pages

SF = "/root/testdata/sf0.001"
STARTS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "text", "div": "text", "address": "text", "li": "item", "tr": "row"}


def blocks(page):
    """Kind and text of each part of a page between tags that begin or end one, without what is no content."""
    page = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(nav|footer|script|style|header)\b.*?</\1>", "\x00", page)
    kind, held = None, ""
    for piece in re.split(r"(<[^>]*>|\x00)", page) + ["\x00"]:
        tag = re.match(r"<(/?)([a-z0-9]+)", piece)
        ends = piece == "\x00" or tag and (tag[2] in STARTS or tag[1] and tag[2] in ("ul", "ol", "table"))
        if ends:
            text = re.sub(r"\s+", " ", html.unescape(held)).strip()
            if kind and text:
                yield kind, text
            kind, held = STARTS.get(tag[2]) if tag and not tag[1] else None, ""
        elif tag:
            held += " " if not tag[1] and tag[2] in ("br", "td", "th") else ""
        elif kind:
            held += piece


def plain(page):
    found = list(blocks(page))
    for k, (kind, text) in enumerate(found):
        if kind == "heading" and 3 <= len(text) <= 150 and text.lower() not in pages.PARTS:
            after = found[k + 1 : k + 6]
            stop = next((n for n, (other, _) in enumerate(after) if other == "heading"), len(after))
            yield "heading", text, " | ".join([text, *(t for _, t in after[:stop])])
        elif kind == "row" or kind == "item" and 15 <= len(text) <= 400:
            if re.search(pages.PHONE, text) or re.search(pages.ADDRESS, text):
                yield "table" if kind == "row" else "list", text[:80], text


def test_all_pages(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    wanted = sorted((r["page_id"], *record) for r in given for record in plain(r["html"]))
    got = catalogue.QUERIES["page_records"](spark, SF).where("strategy IS NOT NULL").collect()
    assert sorted((r["page_id"], r["strategy"], r["name"], r["text"]) for r in got) == wanted and wanted
    for r in got:
        phone, address, zips = re.search(pages.PHONE, r["text"]), re.search(pages.ADDRESS, r["text"]), re.findall(r"\b\d{5}\b", r["text"])
        assert (r["phone"], r["address"], r["zip"]) == (phone and phone[0], address and address[0], zips[-1] if zips else None)


def test_blocks_keep_the_digits_at_their_ends(spark):
    texts = spark.createDataFrame([(1, "0 Elm Hall\n301-555-8630 \n\n 1st Church\nMD 20811\n\npage 3\n\n2 Oak Ave\ncall 2")], "doc_id long, text string")
    got = [(r["block"], r["name"], r["text"], r["phone"], r["zip"]) for r in pages.block_records(texts, "doc_id", "text").collect()]
    assert got == [(0, "0 Elm Hall", "0 Elm Hall 301-555-8630", "301-555-8630", None), (1, "1st Church", "1st Church MD 20811", None, "20811"), (2, "2 Oak Ave", "2 Oak Ave call 2", None, None)]
