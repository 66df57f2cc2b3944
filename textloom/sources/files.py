"""Files of several formats as documents and elements."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import labels
from textloom.functions.text import document_id
from textloom.sources.html import html_scan
from textloom.sources.text import markdown_scan, text_scan

_SUFFIXES = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx", "pptx": "pptx", "pdf": "pdf", "txt": "text"}


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (of the bytes), source_file, format, content of every file below a path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(document_id(F.col("content")).alias("doc_id"), F.col("path").alias("source_file"), file_format(F.col("path"), F.col("content")).alias("format"), "content")


def file_format(path: Column, content: Column) -> Column:
    """By the first bytes, then by the suffix; text when neither says more."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    by_suffix = F.try_element_at(F.create_map(*[F.lit(x) for pair in _SUFFIXES.items() for x in pair]), suffix)
    magic = F.hex(F.substring(content, 1, 4))
    return F.when(magic == "25504446", "pdf").when(magic.startswith("504B"), F.when(suffix.isin("pptx", "xlsx"), suffix).otherwise("docx")).otherwise(F.coalesce(by_suffix, F.lit("text")))


def span_label(spans: DataFrame) -> Column:
    """Label of a text span of a page layout: by font, size in points, weight and page."""
    size, bold = F.col("size"), F.coalesce(F.col("bold"), F.lit(False))
    return (
        F.when(F.lower("font").rlike("mono|courier|consol"), "code_block")
        .when((size >= 16) | ((size >= 13) & bold), F.when(F.col("page") == 1, "document_title").otherwise("section_title"))
        .when((size >= 12) & bold, "subsection_title").otherwise("paragraph")
    )


def flatten_table(rows: Column) -> tuple[Column, Column]:
    """Text (cells that are not empty, joined by bars) and HTML of a table given as rows of cells."""
    cells = F.filter(F.flatten(rows), lambda c: F.coalesce(c, F.lit("")) != "")
    line = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.array_join(cells, " | "), F.concat(F.lit("<table>"), F.array_join(line, ""), F.lit("</table>"))


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _name(t.tag) == "t").strip()


def docx_elements(raw: bytes) -> list[tuple[str, str, int]]:
    """(label, text, page): paragraphs by style first, then all tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    titles = {"title": "document_title", "heading1": "document_title", "heading2": "section_title", "heading3": "subsection_title"}
    inside = {p for t in body.iter() if _name(t.tag) == "tbl" for p in t.iter() if _name(p.tag) == "p"}
    found = []
    for p in (x for x in body.iter() if _name(x.tag) == "p" and x not in inside):
        style = next((v for s in p.iter() if _name(s.tag) == "pStyle" for k, v in s.attrib.items() if _name(k) == "val"), "").lower().replace(" ", "")
        if text := _texts(p):
            found.append((titles.get(style, "list_item" if "list" in style else "paragraph"), text, 1))
    for t in (x for x in body.iter() if _name(x.tag) == "tbl"):
        if text := " | ".join(filter(None, (_texts(c) for c in t.iter() if _name(c.tag) == "tc"))):
            found.append(("table", text, 1))
    return found


def pptx_elements(raw: bytes) -> list[tuple[str, str, int]]:
    """(label, text, page): a slide is a page; paragraphs of the first level are section titles."""
    deck = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((n for n in deck.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0))
    found = []
    for page, name in enumerate(slides, 1):
        for p in (x for x in ElementTree.fromstring(deck.read(name)).iter() if _name(x.tag) == "p"):
            level = next((int(s.attrib.get("lvl", 0)) for s in p if _name(s.tag) == "pPr"), 0)
            if text := _texts(p):
                found.append(("paragraph" if level else "section_title", text, page))
    return found


def office_scan(files: DataFrame) -> DataFrame:
    """Elements of DOCX and PPTX files; one that cannot be read becomes one paragraph of confidence 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, kind, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "format", "content")), strict=True):
                try:
                    found = [(*e, 1.0) for e in (pptx_elements if kind == "pptx" else docx_elements)(raw)]
                except Exception as e:
                    found = [("paragraph", f"[Parse error: {e}]", 1, 0.0)]
                rows += [(doc_id, i, *e) for i, e in enumerate(found)]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "seq", "label", "text", "page", "confidence"])

    return files.select("doc_id", "format", "content").mapInArrow(task, "doc_id string, seq int, label string, text string, page int, confidence double")


def scan(files: DataFrame) -> DataFrame:
    """Elements of all files, by format. PDF needs a layout library and is left to a plug-in.

    Bytes that are not UTF-8 become U+FFFD, each file for itself.
    """
    text = files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))
    html = html_scan(text.where("format = 'html'").select("doc_id", F.col("text").alias("html")), "doc_id")
    return text_scan(text.where("format = 'text'")).unionByName(markdown_scan(text.where("format = 'markdown'"))).unionByName(html).unionByName(office_scan(files.where("format in ('docx', 'pptx')")))


def page_counts(elements: DataFrame) -> DataFrame:
    """doc_id, page_count, n_elements of every document with elements."""
    return elements.groupBy("doc_id").agg(F.max("page").alias("page_count"), F.count(F.lit(1)).alias("n_elements"))


def convert(elements: DataFrame) -> DataFrame:
    """Elements with known labels, their modality, and defaults for page and confidence."""
    label = labels.known_label(F.col("label"))
    return elements.withColumns({"label": label, "modality": labels.modality(label), "page": F.coalesce("page", F.lit(1)), "confidence": F.coalesce("confidence", F.lit(1.0))})


def needs_ocr(pages: DataFrame, elements: DataFrame, min_chars: int = 30) -> DataFrame:
    """Pages (doc_id, page, images) with an image and no element text of more than ``min_chars`` characters."""
    texts = elements.where(F.length("text") > min_chars).select("doc_id", "page").distinct()
    return pages.where("images >= 1").join(texts, ["doc_id", "page"], "left_anti")
