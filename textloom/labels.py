"""The dimension of element labels: modality, role in chunking, cross-reference group."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# They must be these for results to agree.
# label, modality, role (text, title, caption, atomic, skip), cross-reference group
LABELS = (
    ("document_title", "text", "title", None),
    ("section_title", "text", "title", None),
    ("subsection_title", "text", "title", None),
    ("paragraph", "text", "text", None),
    ("abstract", "text", "text", None),
    ("list_item", "text", "text", None),
    ("blockquote", "text", "text", None),
    ("footnote", "text", "text", None),
    ("header", "text", "skip", None),
    ("footer", "text", "skip", None),
    ("page_number", "text", "skip", None),
    ("formula", "formula", "atomic", "equation"),
    ("formula_block", "formula", "atomic", "equation"),
    ("inline_formula", "text", "text", None),
    ("chemical_formula", "formula", "atomic", None),
    ("equation_number", "text", "text", None),
    ("table", "table", "atomic", "table"),
    ("table_caption", "text", "caption", None),
    ("table_footnote", "text", "text", None),
    ("figure", "image", "atomic", "figure"),
    ("image", "image", "atomic", "figure"),
    ("figure_caption", "text", "caption", None),
    ("chart", "image", "atomic", "figure"),
    ("flowchart", "graph", "atomic", "diagram"),
    ("diagram", "graph", "atomic", "diagram"),
    ("relationship_graph", "graph", "atomic", None),
    ("medical_scan", "image", "atomic", None),
    ("histology", "image", "atomic", None),
    ("clinical_photo", "image", "atomic", None),
    ("algorithm", "algorithm", "atomic", "algorithm"),
    ("pseudo_code", "algorithm", "atomic", "algorithm"),
    ("code_block", "code", "atomic", "listing"),
    ("citation", "text", "text", None),
    ("reference_list", "text", "text", None),
    ("seal", "image", "skip", None),
)
SKIPPED = tuple(label for label, _, role, _ in LABELS if role == "skip")
MODALITIES = ("text", "image", "table", "formula", "algorithm", "graph", "code", "mixed")
ENRICHER_OF = {"image": "caption", "table": "caption", "formula": "formula", "algorithm": "caption", "code": "caption", "graph": "graph"}


def label_dim(spark: SparkSession) -> DataFrame:
    """label, modality, role, xref_group: 35 rows."""
    return spark.createDataFrame(LABELS, "label string, modality string, role string, xref_group string")


def _lookup(label: Column, field: int, default: str | None) -> Column:
    pairs = [F.lit(x) for x in chain.from_iterable((row[0], row[field]) for row in LABELS if row[field] is not None)]
    found = F.try_element_at(F.create_map(*pairs), label)
    return found if default is None else F.coalesce(found, F.lit(default))


def known_label(label: Column) -> Column:
    """Labels outside the dimension, and null, are paragraphs."""
    return F.when(label.isin([row[0] for row in LABELS]), label).otherwise(F.lit("paragraph"))


def modality(label: Column) -> Column:
    return _lookup(label, 1, "text")


def role(label: Column) -> Column:
    return _lookup(label, 2, "text")


def xref_group(label: Column) -> Column:
    return _lookup(label, 3, None)


def known_modality(name: Column) -> Column:
    """Modalities outside the list, and null, are text."""
    return F.when(name.isin(list(MODALITIES)), name).otherwise(F.lit("text"))
