import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from textloom.llm import exact, lines, neardup, substrings


def varied(seed, n, vocabulary=60, length=60):
    """Texts and copies of them with some words changed."""
    r = random.Random(seed)
    texts = []
    while len(texts) < n:
        base = [f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, length))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            copy = [x if r.random() > r.choice([0.01, 0.03, 0.06]) else f"w{r.randrange(vocabulary)}" for x in base]
            texts.append(" ".join(copy))
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize("run", [exact.exact_groups, neardup.groups, substrings.removals, lines.summaries])
def test_awkward_documents(spark, run):
    plain, clashing, empty = brute.frames(spark)
    got = sorted(map(repr, run(plain).collect()))
    assert len(got) == len(brute.awkward())
    assert sorted(map(repr, run(clashing).collect())) == got
    assert run(empty).count() == 0


def test_exact_keeps_the_longest_then_the_smallest_id(spark):
    rows = [(1, "ab"), (2, " a b "), (3, "a\tb\n "), (4, "c"), (5, None), (6, ""), (None, "c")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False), (4, 4, 2, True), (None, 4, 2, False), (5, 5, 2, True), (6, 5, 2, False)}


def test_exact_index_persists_and_keeps_earlier_decisions(spark):
    first = exact.DigestIndex(spark, buckets=3)
    first.append(exact.digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")))
    first.forget()
    again = exact.DigestIndex(spark, first.path, buckets=3)
    batch = exact.digests(spark.createDataFrame([(3, "a "), (4, "c"), (5, "c")], "doc_id long, text string"))
    assert sorted((r.keep_id, r.in_batch, r.copies) for r in again.append(batch).collect()) == [(1, 1, 2), (4, 2, 2)]
    assert sorted((r.keep_id, r.copies) for r in again.read().collect()) == [(1, 2), (2, 1), (4, 2)]
    plan = batch.hint("merge").join(again.read().hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    later = exact.exact_groups(spark.createDataFrame([(6, "c"), (7, "a"), (8, "new")], "doc_id long, text string"), again)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in later.collect()) == [(6, 4, 3, False), (7, 1, 3, False), (8, 8, 1, True)]


def test_a_small_batch_against_a_large_index_moves_little_of_it(spark, monkeypatch):
    index, seen, join = exact.DigestIndex(spark, buckets=4), [], exact.join_counted
    index.append(exact.digests(spark.range(20_000).selectExpr("id doc_id", "cast(id as string) text")))
    monkeypatch.setattr(exact, "join_counted", lambda left, right, *a: (seen.append(right.count()), join(left, right, *a))[1])
    batch = exact.exact_groups(spark.createDataFrame([(90_000, "5"), (90_001, "x")], "doc_id long, text string"), index)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in batch.collect()) == [(90_000, 5, 2), (90_001, 90_001, 1)]
    assert seen == [2]


def test_exact_drop_keeps_all_columns(spark):
    _, clashing, _ = brute.frames(spark)
    kept = exact.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 3, 4, 4, 6, 7, 8, 9, 11]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    docs = varied(seed, 150)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    want = brute.near_components(docs, 4)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(got[i][1] == len(brute.shingles(t, 4)) for i, t in docs)


def thue_morse(n, a="a", b="b"):
    """Words of n letters for which polynomials modulo a power of two all have the same value."""
    x, y = a, b
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_long_words_that_differ_are_different(spark, n):
    x, y = thue_morse(n)
    before, after = [f"b{i}" for i in range(17)], [f"a{i}" for i in range(17)]
    docs = [(1, " ".join([*before, x, *after])), (2, " ".join([*before, y, *after])), (3, x), (4, y), (5, " ".join(x)), (6, " ".join(y))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.groups(df, shingle=4).collect()} == brute.near_components(docs, 4)
    assert sorted(map(tuple, substrings.removals(df).collect())) == brute.removals(docs, 35)


def test_near_links_that_no_hub_sees(spark):
    """A chain of copies, each near its neighbours only, has to end as one group."""
    r = random.Random(3)
    at, docs = [f"w{r.randrange(10**6)}" for _ in range(200)], []
    for i in range(30):
        docs.append((i, " ".join(at)))
        for _ in range(3):
            at[r.randrange(200)] = f"w{r.randrange(10**6)}"
    got = {x.doc_id: x.component_id for x in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute.near_components(docs, 4)


def test_nodes_across_components_are_compared_in_blocks(spark, monkeypatch):
    docs = varied(5, 120, length=80)
    want = brute.near_components(docs, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK_NODES", 4)
    # Without links from hubs, all links have to come from the blocks.
    monkeypatch.setattr(neardup, "verified", lambda pairs, *_: pairs.limit(0).toDF("a", "b"))
    assert {x.doc_id: x.component_id for x in neardup.groups(df, shingle=4).collect()} == want


@pytest.mark.parametrize("block", [512, 4])
def test_nodes_come_once_to_a_part_and_all_that_should_meet_do(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_NODES", block)
    rows = [(1, n, 100 + n % 3 if n % 4 else 100, 50) for n in range(30)] + [(2, n, n, 50) for n in range(5)]
    dealt = neardup._dealt(spark.createDataFrame(rows, "key long, node long, root long, n_shingles long")).collect()
    assert len({(r.key, r.part, r.node) for r in dealt}) == len(dealt)
    met = {(r.key, *sorted((r.node, s.node))) for r in dealt for s in dealt if (r.key, r.part) == (s.key, s.part) and r.root != s.root and r.side != 1 and s.side != 0}
    assert met == {(k, a, b) for k, a, x, _ in rows for j, b, y, _ in rows if j == k and a < b and x != y}


def test_sets_are_not_written_beside_their_shuffle(spark, monkeypatch):
    written, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: written.extend(c for c in df.columns if c in "ab" and dict(df.dtypes)[c] == "binary") or write(df, name))
    docs = varied(6, 60)
    got = {x.doc_id: x.component_id for x in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute.near_components(docs, 4) and not written


def test_likelihood_estimate_is_near_the_truth():
    import numpy as np

    r = np.random.default_rng(1)
    x, y = r.integers(0, 2**63, (2, 4000)).astype(np.uint64)
    for share in (0.0, 0.3, 0.8, 1.0):
        n = int(4000 * 2 * share / (1 + share))
        both = np.concatenate([x[:n], y[n:]])
        union = np.unique(np.concatenate([x, both]))
        a, b, c = neardup.registers(np.concatenate([np.unique(x), np.unique(both), union]), np.array([0, 4000, 8000, 8000 + len(union)]))
        size = np.array([4000.0])
        assert abs(neardup.estimate(a[None], b[None], size, size)[0] - share) < 0.15
        assert (np.maximum(a, b) == c).all()


def test_one_of_each_near_group_stays(spark):
    docs = varied(7, 100)
    kept = neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.near_components(docs, 5).values()))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_exact_drop_keeps_one_of_rows_that_share_an_id(spark, doc_id):
    """The row that stays is not taken for the copy with less white space."""
    rows = spark.createDataFrame([(doc_id, "a b"), (doc_id, "ab"), (8, "c"), (None, "d")], "doc_id long, text string")
    assert sorted(r.text for r in exact.drop_copies(rows).collect()) == ["a b", "c", "d"]


def test_near_copy_does_not_take_other_texts_of_its_id_along(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = [(3, base), (5, base + " end"), (5, other), (None, base)]
    kept = neardup.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame([(3, base), (5, other), (None, base)], "doc_id long, text string").collect()))


def test_substrings_equal_brute_force(spark):
    r = random.Random(11)
    passages = [[f"p{i}_{j}" for j in range(r.randrange(8, 30))] for i in range(12)]
    docs = []
    for i in range(120):
        text = []
        for _ in range(r.randrange(6)):
            text += r.choice(passages) if r.random() < 0.5 else [f"u{r.randrange(40)}" for _ in range(r.randrange(15))]
        docs.append((i, r.choice([" ", "\n", "\t "]).join(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substrings.removals(df, window=10, seed=4).collect())) == brute.removals(docs, 10)


def test_substrings_with_small_ranges_and_blocks(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(90))) for i in range(40)]
    monkeypatch.setattr(substrings, "RANGE_HASHES", 50)
    got = substrings.removals(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), window=12, seed=5)
    assert sorted(map(tuple, got.collect())) == brute.removals(docs, 12)


@pytest.mark.parametrize("size", [1, 7, 1 << 19])
def test_repeated_hashes_by_ranges_of_any_number(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "RANGE_HASHES", size)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    values[:3] = 0, 1 << 63, (1 << 64) - 1
    held = {b: rng.choice(values, n) for b, n in enumerate([200, 1, 0, 90, 90])}
    rows = [(b, len(h), h.tobytes()) for b, h in held.items()]
    found = substrings.repeated(spark.createDataFrame(rows, "block long, hashes long, h binary"), ["h"], substrings.seed_hashes, 1)
    parts = {r.block: [p.asDict() for p in r.parts] for r in found.collect()}
    counts = Counter(x for h in held.values() for x in h.tolist())
    assert set(parts) == {0, 1, 3, 4} and all(len(p) <= len(held[b]) for b, p in parts.items())
    for b, h in held.items():
        assert substrings.flagged(h.reshape(-1, 1), parts.get(b, [])).tolist() == [counts[x] > 1 for x in h.tolist()]


def test_substring_texts(spark):
    docs = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "only here")]
    got = substrings.kept_texts(spark.createDataFrame(docs, "doc_id long, text string"), window=4, seed=2)
    assert sorted(map(tuple, got.collect())) == [(1, "a f"), (2, "x y")]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_distance_equals_dynamic_programming(spark, threshold):
    r = random.Random(threshold)
    pairs = []
    for _ in range(300):
        a = b = "".join(r.choice("abé😀") for _ in range(r.randrange(threshold, 25)))
        for _ in range(r.randrange(threshold + 3)):
            i = r.randrange(len(b) + 1)
            b = r.choice([b[:i] + b[i + 1 :], b[:i] + "a" + b[i:], b[:i] + "b" + b[i + 1 :]])
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if len(a) - len(b) <= threshold:
            pairs.append((a, b))
    points = "transform(regexp_extract_all({}, '(?s).', 0), c -> ascii(c))"
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", points.format("a") + " x", points.format("b") + " y").withColumn("n", F.expr(lines.edit_distance("x", "y", threshold)))
    assert [(r.a, r.b, r.n) for r in rows.collect()] == [(a, b, min(brute.edits(a, b), threshold + 1)) for a, b in pairs]


@pytest.mark.parametrize(("hot", "block", "salted"), [(1000, 256, 1000), (1, 2, 1000), (1000, 2, 1)])
def test_line_summaries_equal_brute_force(spark, monkeypatch, hot, block, salted):
    monkeypatch.setattr(lines, "HOT_LINES", hot)
    monkeypatch.setattr(lines, "BLOCK_LINES", block)
    monkeypatch.setattr(lines, "SALTED_LINES", salted)
    r = random.Random(9)
    made = ["the same line everywhere, long enough", "short one"] * 3
    for _ in range(80):
        line = "".join(r.choice("abcdefgh é") for _ in range(r.randrange(17, 40))).strip()
        made.append(line)
        for _ in range(r.randrange(4)):
            b = line
            for _ in range(r.randrange(5)):
                i = r.randrange(len(b) + 1)
                b = r.choice([b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "y" + b[i + 1 :]])
            made.append(r.choice([b, b.replace(" ", " \t "), f" {b}\r"]))
    docs = [(i, "\n".join(made[i * 3 : i * 3 + 3])) for i in range(len(made) // 3)]
    docs = [*docs, (None, made[8] + "\n\n" + made[9]), (10_000, None), (10_001, " \n\t")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(repr, brute.line_summaries(docs)))
    assert sorted(repr(tuple(x)) for x in lines.summaries(df).collect()) == want
    # Rows that repeat a document get its result.
    assert sorted(repr(tuple(x)) for x in lines.summaries(df.unionByName(df.limit(1))).distinct().collect()) == want


def test_lines_and_distances_are_worked_out_once(spark):
    """A filter on a computed column would compute it again."""
    docs = spark.createDataFrame([(1, " a line \t of  text \r\n\n two\x0b"), (2, None), (3, " \n")], "doc_id long, text string")
    split = lines.occurrences(docs).where("length(line) > 2")
    assert [(r.doc, r.at, r.line) for r in split.collect()] == [(1, 0, "a line of text"), (1, 2, "two")]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1
    texts = spark.createDataFrame([(2, "the same line"), (4, "the same lines"), (6, "the sand lives")], "h long, line string")
    near = lines.verified(spark.createDataFrame([(2, 4), (2, 6), (4, 6)], "a long, b long"), texts, 2)
    assert sorted(r.distance for r in near.collect()) == [1]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("shiftright(") == lines.edit_distance("x", "y", 2).count("shiftright(")


def test_lines_of_one_key_make_no_rows_of_pairs(spark, monkeypatch):
    """Twenty lines with the same ending are compared in a block, not in the join by key; all their pairs are found."""
    texts = spark.createDataFrame([(f"{i:02d} and the same long ending of every line here",) for i in range(20)], "line string")
    blocks, compare = [], lines._hot_pairs
    monkeypatch.setattr(lines, "_hot_pairs", lambda rows, *a: blocks.append(rows.select("h").distinct().count()) or compare(rows, *a))
    made = lines.candidates(texts, lines.THRESHOLD, lines.MIN_CHARS, 20, texts)[0]
    assert blocks == [20] and made.count() == 20 * 19 // 2


def test_documents_are_split_into_lines_three_times_with_hot_keys_too(spark, monkeypatch, tmp_path):
    """For the lines, their keys, and the lines that meet."""
    monkeypatch.setattr(lines, "HOT_LINES", 2)
    docs = [(i, f"one and the same beginning of line {i:03d}\nanother text, number {i}") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    read, write = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda df, name: read.append(name) or write(df, name) if any(f.startswith(f"file://{tmp_path}") for f in df.inputFiles()) else write(df, name))
    got = sorted(repr(tuple(x)) for x in lines.summaries(spark.read.parquet(f"{tmp_path}/docs")).collect())
    assert got == sorted(map(repr, brute.line_summaries(docs)))
    assert read == ["lines", "line-keys", "line-texts"]


def test_first_occurrence_of_a_line_class_stays(spark):
    near = "a line that is long enough to be compared"
    docs = [(2, f"{near}\nshort\nshort"), (1, f"x\n{near}!\n\n"), (3, "short")]
    got = lines.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: f"x\n{near}!\n\n", 2: "short", 3: ""}
