"""Cross-references between chunks: "Figure 3" to the third figure of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import labels

# The words that announce a reference, and the group each counts in.
KEYWORDS = {
    "figure": "figure", "fig.": "figure", "table": "table", "algorithm": "algorithm", "alg.": "algorithm", "equation": "equation",
    "eq.": "equation", "chart": "figure", "diagram": "diagram", "listing": "listing", "code": "listing",
}
#: Keywords whose own name is a group: only these resolve in strict mode.
STRICT = ("figure", "table", "algorithm", "equation", "diagram", "listing")
_PATTERN = r"(?i)\b(Figure|Fig\.|Table|Algorithm|Alg\.|Equation|Eq\.|Chart|Diagram|Listing|Code)\s+(\d+)\b"


def cross_references(chunks: DataFrame, strict: bool = True) -> DataFrame:
    """doc_id, chunk_seq, refs: the chunks that each chunk refers to or is referred to by, ascending.

    ``chunks`` has doc_id, chunk_seq, modality, element_types, text. In strict mode
    abbreviations, charts and code never resolve; otherwise every keyword counts in its
    group. A chunk without references has no row.
    """
    order = Window.partitionBy("doc_id", "xref_group").orderBy("chunk_seq", "at")
    index = (
        chunks.select("doc_id", "chunk_seq", F.posexplode("element_types").alias("at", "label"))
        .withColumn("xref_group", labels.xref_group(F.col("label"))).where("xref_group is not null")
        .select("doc_id", "xref_group", F.row_number().over(order).cast("decimal(38,0)").alias("number"), F.col("chunk_seq").alias("target"))
    )
    keyword = F.lower(F.regexp_extract("found", r"^(\S+)", 1))
    names = {k: v for k, v in KEYWORDS.items() if not strict or k in STRICT}
    group = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), keyword)
    # Numbers beyond 38 digits, like all without a target, resolve to nothing.
    number = F.expr(r"try_cast(regexp_extract(found, '(\\d+)$', 1) as decimal(38,0))")
    asked = (
        chunks.where("modality = 'text'").select("doc_id", "chunk_seq", F.explode(F.expr(f"regexp_extract_all(text, r'{_PATTERN}', 0)")).alias("found"))
        .select("doc_id", "chunk_seq", group.alias("xref_group"), number.alias("number")).where("xref_group is not null")
    )
    links = asked.join(index, ["doc_id", "xref_group", "number"]).select("doc_id", "chunk_seq", "target").distinct()
    both = links.unionByName(links.select("doc_id", F.col("target").alias("chunk_seq"), F.col("chunk_seq").alias("target"))).distinct()
    return both.groupBy("doc_id", "chunk_seq").agg(F.array_sort(F.collect_list("target")).alias("refs"))
