"""Section-aware chunks from elements, as one fold per document.

The fold carries the section path, a pending title and an accumulator. It runs as
``aggregate`` over a document's elements in order, so a document costs one array and
one task needs no more than its own documents. Elements are brought together once,
by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import labels
from textloom.functions.text import WHITE, strip, token_count
from textloom.functions.vectors import cosine

MAX_TOKENS = 512
_CHUNK = "struct<modality:string,element_types:array<string>,text:string,page:int,confidence:double,section_path:array<string>,is_atomic:boolean,latex:string,html:string>"


def _tokens(text: str) -> str:
    return f"size(filter(split({text}, r'{WHITE}'), w -> w <> ''))"


def _cast(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _chunk(**fields: str) -> str:
    return f"cast({_cast(**fields)} as {_CHUNK})"


def fold_sql(max_tokens: int, overlap_tokens: int) -> str:
    """The fold as SQL over the array ``elements``.

    ``overlap_tokens`` last words of a full chunk open the next one; 0 by default,
    where chunks share nothing.
    """
    none, texts = "cast(array() as array<string>)", "s.texts"
    flushed = _chunk(modality="'text'", element_types="array_distinct(s.types)", text="array_join(s.texts, '\\n\\n')", page="s.page", confidence="s.confidence", section_path="s.path", is_atomic="false", latex="cast(null as string)", html="cast(null as string)")
    out = f"if(size({texts}) > 0, concat(s.chunks, array({flushed})), s.chunks)"
    empty = {"texts": none, "types": none, "tokens": "0", "confidence": "1.0D"}
    title = _cast(
        path="case e.label when 'document_title' then array(e.text) when 'section_title' then concat(slice(s.path, 1, 1), array(e.text)) else concat(slice(s.path, 1, 2), array(e.text)) end",
        pending="e.text", **empty, page="s.page", chunks=out)
    caption = _cast(path="s.path", pending="e.text", **empty, page="s.page", chunks=out)
    joined = "concat_ws('\\n\\n', nullif(s.pending, ''), nullif(e.text, ''))"
    alone = _chunk(modality="e.modality", element_types="array(e.label)", text=f"if({joined} = '', concat('[', e.label, ']'), {joined})", page="e.page", confidence="e.confidence", section_path="s.path", is_atomic="true", latex="e.latex", html="e.html")
    atomic = _cast(path="s.path", pending="''", **empty, page="s.page", chunks=f"concat({out}, array({alone}))")
    full = f"(s.tokens + e.tokens > {max_tokens} and size(s.texts) > 0)"
    tail = f"array_join(slice(filter(split(array_join(s.texts, ' '), r'{WHITE}'), w -> w <> ''), -least({overlap_tokens}, greatest(1, {_tokens("array_join(s.texts, ' ')")})), {overlap_tokens}), ' ')"
    carried = f"if({full}, {f'array({tail})' if overlap_tokens else none}, s.texts)"
    first = f"(s.pending <> '' and size({carried}) = 0)"
    text = _cast(
        path="s.path", pending=f"if({first}, '', s.pending)",
        texts=f"concat({carried}, array(concat(if({first}, concat(s.pending, '\\n\\n'), ''), e.stripped)))",
        types=f"concat(if({full}, {none}, s.types), array(e.label))",
        tokens=f"if({full}, {overlap_tokens}, s.tokens) + e.tokens + if({first}, {_tokens('s.pending')}, 0)",
        confidence=f"least(if({full}, 1.0D, s.confidence), e.confidence)", page="e.page", chunks=f"if({full}, {out}, s.chunks)")
    start = _cast(path=none, pending="''", **empty, page="1", chunks=f"cast(array() as array<{_CHUNK}>)")
    step = f"case e.role when 'title' then {title} when 'caption' then {caption} when 'atomic' then {atomic} else if(e.stripped = '', s, {text}) end"
    return f"aggregate(elements, {start}, (s, e) -> {step}, s -> {out})"


def chunk(elements: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = 0) -> DataFrame:
    """doc_id, chunk_seq, chunk_id and the chunk's fields.

    ``elements`` has doc_id, seq, label, text, page, confidence, and may have latex and
    html. Unknown labels are paragraphs, null texts empty, a null page is 1 and a null
    confidence 1.0. Elements with equal seq keep the order of their texts.
    """
    for name in ("latex", "html"):
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(None).cast("string"))
    text = F.coalesce("text", F.lit(""))
    label = labels.known_label(F.col("label"))
    rows = elements.select(
        "doc_id",
        F.struct(
            F.col("seq"), text.alias("text"), label.alias("label"), labels.role(label).alias("role"), labels.modality(label).alias("modality"), strip(text).alias("stripped"), token_count(text).alias("tokens"),
            F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("page"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"), "latex", "html",
        ).alias("e"),
    ).where("e.role <> 'skip'")
    folded = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("elements")).select("doc_id", F.posexplode(F.expr(fold_sql(max_tokens, overlap_tokens))).alias("chunk_seq", "c"))
    return folded.select(
        "doc_id", "chunk_seq", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_seq").cast("string")), 256).alias("chunk_id"), "c.*",
        token_count(F.col("c.text")).alias("token_count"),
    )


def semantic_merge(chunks: DataFrame, threshold: float = 0.85, max_tokens: int = 64) -> DataFrame:
    """Joins neighbouring small text chunks of a document whose vectors are alike, two by two.

    ``chunks`` has doc_id, chunk_seq, modality, text, token_count, confidence, embedding.
    A left-to-right scan that skips what it has merged takes, in each run of likable
    neighbours, the first, third, fifth ... link; so runs are numbered and odd links kept.
    Returns doc_id, chunk_seq (of the first), text, merged, confidence, token_count.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_seq")
    small = (F.col("modality") == "text") & (F.col("token_count") < max_tokens)
    ahead = chunks.withColumn("small", small).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("small", "text", "embedding", "confidence")})
    linked = ahead.withColumn("link", F.coalesce(F.col("small") & F.col("next_small") & (cosine(F.col("embedding"), F.col("next_embedding"), 1e-9) >= threshold), F.lit(False)))
    runs = linked.withColumn("run", F.sum(F.when(F.col("link"), 0).otherwise(1)).over(order))
    # A row that breaks a run closes the one before; count links from the run's start.
    place = F.sum(F.col("link").cast("int")).over(Window.partitionBy("doc_id", "run").orderBy("chunk_seq"))
    taken = runs.withColumn("takes", F.col("link") & (place % 2 == 1)).withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))
    both = F.concat_ws("\n\n", "text", "next_text")
    text = F.when(F.col("takes"), both).otherwise(F.col("text"))
    return taken.where("not taken").select("doc_id", "chunk_seq", text.alias("text"), F.col("takes").alias("merged"), F.when(F.col("takes"), F.least("confidence", "next_confidence")).otherwise(F.col("confidence")).alias("confidence"), token_count(text).alias("token_count"))


def render_markdown(elements: DataFrame) -> DataFrame:
    """doc_id, markdown: the elements of each document as Markdown, blank-line separated."""
    kept = elements.where(~F.col("label").isin(list(labels.SKIPPED))).withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = F.lag(F.when(F.col("label").isin("figure_caption", "table_caption"), F.col("text"))).over(order)
    for name in ("latex", "html"):
        if name not in kept.columns:
            kept = kept.withColumn(name, F.lit(None).cast("string"))
    # The Markdown form of each label; {} is the text.
    forms = {
        "document_title": "# {}", "section_title": "## {}", "subsection_title": "### {}", "list_item": "- {}", "blockquote": "> {}",
        "footnote": "[^note]: {}", "citation": "[{}]", "reference_list": "**References**\n\n{}", "figure_caption": "*{}*", "table_caption": "*{}*",
        "table_footnote": "_{}_", "chemical_formula": "**Chemical formula:** `{}`", "equation_number": "({})",
        "algorithm": "```\n{}\n```", "pseudo_code": "```\n{}\n```", "code_block": "```\n{}\n```",
    }
    text, label = F.col("text"), F.col("label")
    drawn = F.when(labels.modality(label) == "graph", "<!-- graph: ").when(label.isin("medical_scan", "histology", "clinical_photo"), "<!-- medical-image: ").otherwise("<!-- image: ")
    shown = F.concat(drawn, label, F.lit(" -->"), F.when(~label.isin("medical_scan", "histology", "clinical_photo") & (F.coalesce("caption", F.lit("")) != ""), F.concat(F.lit("\n*"), F.col("caption"), F.lit("*"))).otherwise(""))
    formula = F.coalesce(F.nullif("latex", F.lit("")), text)
    line = F
    for name, form in forms.items():
        left, right = form.split("{}")
        line = line.when(label == name, F.concat(F.lit(left), text, F.lit(right)))
    line = line.when(label.isin("formula", "formula_block"), F.concat(F.lit("$$\n"), formula, F.lit("\n$$"))).when(label == "inline_formula", F.concat(F.lit("$"), formula, F.lit("$")))
    line = line.when(label == "table", F.concat(F.lit("<!-- table -->\n"), F.coalesce(F.nullif("html", F.lit("")), text))).when(labels.modality(label).isin("image", "graph"), shown).otherwise(text)
    rows = kept.withColumn("caption", before).select("doc_id", "seq", line.alias("line")).where("line <> ''")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines")).select("doc_id", F.array_join(F.col("lines.line"), "\n\n").alias("markdown"))
