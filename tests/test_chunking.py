import random

import pytest

from textloom import labels
from textloom.operators.chunking import chunk, render_markdown, semantic_merge
from textloom.operators.xref import cross_references

ELEMENTS = "doc_id string, seq int, label string, text string, page int, confidence double"


def made(spark, rows):
    return spark.createDataFrame([("d", i, *row, 1, 0.9) for i, row in enumerate(rows)], ELEMENTS)


def chunks_of(spark, rows, **kw):
    return sorted(chunk(made(spark, rows), **kw).collect(), key=lambda r: r.chunk_seq)


@pytest.mark.parametrize("label", ["table", "formula", "code_block"])
def test_atomic_elements_stand_alone(spark, label):
    (only,) = chunks_of(spark, [(label, "x" * 100)])
    assert only.is_atomic and only.element_types == [label]


def test_titles_prefix_and_make_the_path(spark):
    found = chunks_of(spark, [("document_title", "My Document"), ("section_title", "Chapter 1"), ("subsection_title", "Section 1.1"), ("paragraph", "Body text here.")])
    assert [c.section_path for c in found] == [["My Document", "Chapter 1", "Section 1.1"]]
    assert found[0].text == "Section 1.1\n\nBody text here."


def test_first_section_stays_the_root_without_a_document_title(spark):
    found = chunks_of(spark, [("section_title", "A"), ("paragraph", "x"), ("section_title", "B"), ("paragraph", "y")])
    assert [c.section_path for c in found] == [["A"], ["A", "B"]]


def test_skipped_elements_and_captions(spark):
    found = chunks_of(spark, [("page_number", "1"), ("header", "My Header"), ("figure_caption", "Fig"), ("figure", ""), ("figure", ""), ("flowchart", "flow")])
    assert [(c.text, c.modality) for c in found] == [("Fig", "image"), ("[figure]", "image"), ("flow", "graph")]


def test_short_paragraphs_gather_until_full(spark):
    assert len(chunks_of(spark, [("paragraph", f"Short paragraph {i}.") for i in range(5)])) == 1
    assert [c.token_count for c in chunks_of(spark, [("paragraph", "a b c")] * 5, max_tokens=6)] == [6, 6, 3]
    assert [c.token_count for c in chunks_of(spark, [("paragraph", "a " * 20)], max_tokens=6)] == [20]


def test_overlap_is_opt_in(spark):
    found = chunks_of(spark, [("paragraph", "a b c"), ("paragraph", "d e f"), ("paragraph", "g h i")], max_tokens=5, overlap_tokens=2)
    assert [c.text for c in found] == ["a b c", "b c\n\nd e f", "e f\n\ng h i"]


def test_nulls_unknown_labels_and_empty_tables(spark):
    rows = [("d", 0, None, None, None, None), ("d", 1, "nonsense", "text", None, None), (None, 0, "paragraph", "orphan", 3, 0.5)]
    found = {c.doc_id: c for c in chunk(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert (found["d"].text, found["d"].page, found["d"].confidence, found["d"].element_types) == ("text", 1, 1.0, ["paragraph"])
    assert found[None].text == "orphan"
    assert chunk(spark.createDataFrame([], ELEMENTS)).count() == 0


def test_label_dimension_is_total(spark):
    dim = labels.label_dim(spark)
    assert dim.count() == 35
    assert dim.select(labels.modality(dim.label) == dim.modality, labels.role(dim.label) == dim.role).distinct().collect() == [(True, True)]


def test_markdown(spark):
    text = render_markdown(made(spark, [("document_title", "T"), ("figure_caption", "C"), ("figure", "x"), ("figure", "x"), ("seal", "s"), ("code_block", "c"), ("inline_formula", "a")])).first().markdown
    assert text == "# T\n\n*C*\n\n<!-- image: figure -->\n*C*\n\n<!-- image: figure -->\n\n```\nc\n```\n\n$a$"


def test_semantic_merge_is_a_left_to_right_scan(spark):
    r = random.Random(4)
    vectors = [[r.choice([0.0, 1.0]), 1.0] for _ in range(40)]
    rows = [("d", i, "text" if r.random() < 0.9 else "table", f"t{i}", 3, 1.0, v) for i, v in enumerate(vectors)]
    got = semantic_merge(spark.createDataFrame(rows, "doc_id string, chunk_seq int, modality string, text string, token_count int, confidence double, embedding array<double>"), threshold=0.9)
    want, i = [], 0
    while i < len(rows):
        pair = i + 1 < len(rows) and rows[i][2] == rows[i + 1][2] == "text" and vectors[i] == vectors[i + 1]
        want.append((i, pair))
        i += 2 if pair else 1
    assert sorted((x.chunk_seq, x.merged) for x in got.collect()) == want


def test_cross_references_link_both_ways(spark):
    rows = [("paragraph", "see Figure 2 and Fig. 1 or Code 1, Figure 99999999999999999999999999999999999999999999"), ("figure", "a"), ("chart", "b"), ("code_block", "c")]
    chunks = chunk(made(spark, rows))
    assert {r.chunk_seq: r.refs for r in cross_references(chunks).collect()} == {0: [2], 2: [0]}
    assert {r.chunk_seq: r.refs for r in cross_references(chunks, strict=False).collect()} == {0: [1, 2, 3], 1: [0], 2: [0], 3: [0]}
