"""Elements from HTML, with built-in expressions only.

A page is split at the tags that begin or end an element: titles, paragraphs, list
items, quotes and preformatted text. What lies between two of them is one element; the
tag before it gives its label. Comments, declarations and all other tags go, character
references become their characters, and all other character data counts, that of
scripts and styles too, in which nothing is a tag. A tag or reference that the end of
the page cuts off is left out with what would have been its text.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The label that a tag opens.
_OPENS = {
    "h1": "document_title", "h2": "section_title", "h3": "subsection_title", "h4": "subsection_title",
    "p": "paragraph", "li": "list_item", "blockquote": "blockquote", "pre": "code_block",
}
_REST = r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+>"""
_BLOCK = rf"(?i)<(/?(?:{'|'.join(_OPENS)}))(?=[\s/>]){_REST}"
_TAG = rf"</?[A-Za-z]{_REST}|<[!?/][^>]*+>"
#: Comments, and scripts and styles, whose content is no markup.
_RAW = r"(?is)<!--.*?-->|<(script|style)\b[^>]*+>.*?</\1\s*+>"
_REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"
#: White space of Unicode: the characters that an element's text neither begins nor ends with.
_BLANK = "".join(chr(n) for n in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# The references that markup itself needs, which need no search through all names.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
_OPEN_REFERENCE = r"&[^\s;<>]{0,33}$"
#: Stand for < and & where they are no markup.
_LESS, _AND = "", ""


def _bound(value: Column, change: Callable[[Column], Column]) -> Column:
    """``change`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), change), F.lit(0))


def _interleaved(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with each match of a pattern changed by a function of the match."""
    # There is one piece more than there are matches.
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda x, y: F.concat(x, F.coalesce(change(y), F.lit("")))), "")


def _unmarked(raw: Column) -> Column:
    """Nothing for a comment; the content of a script or style with no markup in it."""
    inner = F.regexp_replace(F.regexp_replace(raw, r"(?is)^<(?:script|style)\b[^>]*+>", ""), r"(?is)</(?:script|style)\s*+>$", "")
    return F.when(raw.startswith("<!--"), F.lit("")).otherwise(F.translate(inner, "<&", _LESS + _AND))


def _character(reference: Column) -> Column:
    """The characters of one reference; itself when it is unknown."""
    names = html5 | {f"#{n};": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in names.items())), F.lit("\x01"), F.lit("\x02"))
    name = F.substring(reference, 2, 64)
    # Some names need no semicolon; the longest beginning counts.
    beginnings = F.filter(F.transform(F.sequence(F.length(name), F.lit(1), F.lit(-1)), lambda n: F.left(name, n)), lambda x: F.map_contains_key(known, x))
    start = F.get(beginnings, F.lit(0))
    cut = F.concat(F.try_element_at(known, start), F.substring(name, F.length(start) + 1, F.lit(64)))
    digits = F.regexp_extract(reference, r"^&#[xX]?([0-9a-fA-F]+)", 1)
    code = F.when(F.length(digits) > 8, F.lit(-1)).otherwise(F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�"))
    whole = F.try_element_at(known, F.concat(F.rtrim(name, F.lit(";")), F.lit(";")))
    named = F.coalesce(F.when(reference.endswith(";"), whole), cut, reference)
    said = F.when(reference.startswith("&#"), F.coalesce(whole, number)).otherwise(named)
    common = None
    for name, character in _COMMON.items():
        common = (F if common is None else common).when(reference == name, F.lit(character))
    return common.otherwise(said)


def page_elements(html: Column) -> Column:
    """Array of (label, text): the elements of one page; none for a null page."""
    label = F.create_map(*[F.lit(x) for pair in _OPENS.items() for x in pair])

    def text(piece: Column) -> Column:
        plain = _bound(F.regexp_replace(piece, _TAG, ""), lambda bare: F.when(bare.contains("&"), _interleaved(bare, _REFERENCE, _character)).otherwise(bare))
        return F.btrim(F.translate(plain, _LESS + _AND, "<&"), F.lit(_BLANK))

    def whole(page: Column) -> Column:
        # What the end cuts off: a tag, or the text that holds an open reference.
        page = F.regexp_replace(page, r"""(?s)<[A-Za-z/!?](?:"[^"]*+"|'[^']*+'|[^'">])*+(?:["'][^>]*+)?$""", "")
        return _bound(page, lambda x: F.when(x.rlike(_OPEN_REFERENCE), F.regexp_replace(x, rf"(?s)(?<=^|>)[^<>]*{_OPEN_REFERENCE}", "")).otherwise(x))

    def elements(page: Column) -> Column:
        tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(page, F.lit(_BLOCK), F.lit(1)))
        return F.zip_with(F.split(page, _BLOCK), tags, lambda x, tag: F.struct(F.coalesce(F.try_element_at(label, F.lower(tag)), F.lit("paragraph")).alias("label"), text(x).alias("text")))

    raw = _bound(F.coalesce(html, F.lit("")), lambda page: whole(F.when(page.rlike(_RAW), _interleaved(page, _RAW, _unmarked)).otherwise(page)))
    return F.filter(_bound(raw, elements), lambda x: x["text"] != "")


def html_scan(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, seq, label, text, page, confidence."""
    each = pages.select(key, F.posexplode(page_elements(F.col(html))).alias("seq", "e"))
    return each.select(key, "seq", "e.label", "e.text", F.lit(1).alias("page"), F.lit(1.0).alias("confidence"))
