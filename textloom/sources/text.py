"""Elements from plain text and Markdown: one row per element, in order.

Every scan returns doc_id, seq, label, text, page, confidence. A null text has no
elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip


def text_scan(docs: DataFrame) -> DataFrame:
    """Paragraphs between blank lines; the page is the paragraph's number, blank ones counted."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("seq", "raw"))
    return each.select("doc_id", "seq", F.lit("paragraph").alias("label"), strip(F.col("raw")).alias("text"), (F.col("seq") + 1).alias("page"), F.lit(1.0).alias("confidence")).where("text <> ''")


def markdown_scan(docs: DataFrame) -> DataFrame:
    """One element per line that is not blank; the marks of titles, lists and quotes give its label."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "raw")).withColumn("line", strip(F.col("raw"))).where("line <> ''")
    line = F.col("line")
    marks = (("# ", "document_title"), ("## ", "section_title"), ("### ", "subsection_title"), ("- ", "list_item"), ("* ", "list_item"), ("+ ", "list_item"), ("> ", "blockquote"))
    label, text = F, F
    for mark, name in marks:
        label = label.when(line.startswith(mark), name)
        text = text.when(line.startswith(mark), strip(F.substring(line, len(mark) + 1, 1 << 30)))
    return each.select("doc_id", "seq", label.otherwise("paragraph").alias("label"), text.otherwise(line).alias("text"), F.lit(1).alias("page"), F.lit(1.0).alias("confidence"))


#: Labels that synthetic elements take in turn.
TURN = ("section_title", "paragraph", "paragraph", "figure_caption", "figure", "paragraph", "subsection_title", "list_item", "table", "page_number", "code_block", "formula")


def line_elements(docs: DataFrame) -> DataFrame:
    """Elements of every label role from plain documents: each line is one, its label goes by its number."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    label = F.element_at(F.array(*map(F.lit, TURN)), F.col("seq") % len(TURN) + 1)
    return each.select("doc_id", "seq", label.alias("label"), "text", F.expr("cast(seq div 20 + 1 as int)").alias("page"), (1 - (F.col("seq") % 10) / 20).alias("confidence"))
