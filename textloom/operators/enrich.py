"""Enrichment of chunks: captions, concept tags, formula checks.

Models are plug-ins: functions from a DataFrame to a DataFrame with one more column.
The defaults here are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import head, words

Plugin = Callable[[DataFrame], DataFrame]


def caption_text(modality: Column, caption: Column) -> Column:
    """What a caption (JSON text) says, by modality; JSON that is invalid stands for itself."""

    def field(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(caption, f"$.{n}") for n in names], caption)

    steps = F.coalesce(F.from_json(F.get_json_object(caption, "$.steps"), "array<string>"), F.expr("cast(array() as array<string>)"))
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), s)), "\n")
    return (
        F.when(modality == "image", field("caption", "detail")).when(modality == "table", field("semantic_summary", "markdown_repr")).when(modality == "formula", field("verbal_description"))
        .when(modality == "algorithm", F.concat(F.coalesce(F.get_json_object(caption, "$.purpose"), F.lit("")), F.lit("\n"), numbered))
        .when(modality == "code", field("purpose")).when(modality == "graph", field("summary")).otherwise(caption)
    )


def parsed_or_raw(text: Column) -> Column:
    """Valid JSON as it is, anything else as {"raw": text}."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.to_json(F.struct(text.alias("raw"))))


def caption_input(prompt: Column, image: Column, html: Column, latex: Column, text: Column) -> Column:
    """What a captioner is asked: image, else table, else formula, else text."""
    given = [F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (image, html, latex, text)]
    return F.when(given[0].isNotNull(), prompt).when(given[1].isNotNull(), F.concat(prompt, F.lit("\n\nTable HTML:\n"), html)).when(given[2].isNotNull(), F.concat(prompt, F.lit("\n\nLaTeX: "), latex)).when(given[3].isNotNull(), F.concat(prompt, F.lit("\n\nContent:\n"), text))


def enrich(chunks: DataFrame, captioner: Plugin | None = None) -> DataFrame:
    """Adds enriched_text; ``captioner`` adds a column caption. Without one, only chunks that have a caption gain."""
    rows = captioner(chunks) if captioner else chunks
    if "caption" not in rows.columns:
        rows = rows.withColumn("caption", F.lit(None).cast("string"))
    said = caption_text(F.col("modality"), F.col("caption"))
    return rows.withColumn("enriched_text", F.when(F.col("caption").isNotNull(), F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n[Enrichment]\n"), said)).otherwise(F.col("text")))


def capitalised(text: Column, read: int | None = None) -> Column:
    """The default tagger: words that begin with A-Z, of the text or its first ``read`` characters, without the marks around them."""
    bare = F.transform(words(head(text, read)), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(bare, lambda w: w.rlike("^[A-Z][a-z]"))


def concept_tags(text: Column, tagged: Column | None = None, limit: int = 10, read: int | None = None) -> Column:
    """``name:LABEL`` of tagged entities, then the longest candidates of more than three characters; ties by name."""
    entities = F.array_distinct(tagged) if tagged is not None else F.expr("cast(array() as array<string>)")
    phrases = F.filter(F.array_distinct(capitalised(text, read)), lambda w: F.length(w) > 3)
    longest = F.slice(F.array_sort(F.transform(phrases, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, limit)
    return F.array_union(entities, F.transform(longest, lambda x: x["w"]))


@F.pandas_udf(T.StringType())
def latex_fault(formulas: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Why a formula is not well formed: its first unmatched brace, \\left or \\begin; null if it is."""
    import re

    token = re.compile(r"\\\\|\\[{}]|\\(begin|end)\{([^}]*)\}|\\(left|right)(?![A-Za-z])|[{}]")

    def fault(latex: str | None) -> str | None:
        opened: list[str] = []
        for m in token.finditer(latex or ""):
            kind = m[1] or m[3] or m[0]
            if kind in ("begin", "left", "{"):
                opened.append(f"begin {m[2]}" if kind == "begin" else kind)
            elif kind in ("end", "right", "}"):
                wanted = {"end": f"begin {m[2]}", "right": "left", "}": "{"}[kind]
                if not opened or opened.pop() != wanted:
                    return f"unmatched {m[0]}"
        return f"unclosed {opened[-1]}" if opened else None

    for series in formulas:
        yield series.map(fault)
