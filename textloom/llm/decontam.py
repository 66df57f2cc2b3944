"""Benchmark decontamination with a stored, distributed positional inverted index.

1. One pass over the training texts writes the index: a posting (word, document,
   position) for every word. Each task sorts the postings of its own documents by
   word (by its hash), so nothing is shuffled, no word is too frequent for a task, and
   a word's postings lie together. A posting of the empty word carries a document's
   number of words; a lexicon counts every word's postings. The
   index is kept and serves any number of benchmarks.
2. Test items become windows of ``window`` words. The two rarest words of a window by
   the lexicon are its anchors. A window with a word that never occurs is out.
3. Posting lists are intersected from the rarest terms on, after adjusting each
   position by the word's place in the item: postings of anchors that fall on the same
   diagonal (position minus place) meet in one group. A diagonal on which both anchors
   of a window lie is a candidate.
4. A candidate says where all other words of its item would be. These postings are
   looked up in the index, and runs of ``window`` places that are all there are exact
   matches. ``proximity`` instead reports anchors that lie within a slop of each other.

Everything is a built-in expression. Tables of test items and candidates are broadcast
where they are counted to be few; beyond the bound, joins are shuffled with the most
frequent words kept where they are.

Defined results: words are runs of ASCII letters and digits and of all other
characters beyond ASCII, A-Z as a-z. An item of fewer than ``window`` words is one
window; items without words or with a null item_id match nothing, and rows that
repeat an item_id are one item. A null or empty text has no words and no hits. A
null doc_id is a value of its own. Rows that repeat get the same result. Empty tables
give empty results, or no hits. Columns other than doc_id, item_id and text are not
read, whatever their names, and pass through ``clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import lower_ascii, words
from textloom.rows import possible_rows, without_rows
from textloom.skew import join_counted
from textloom.storage import maybe_broadcast, materialize, new_path, read_table, small_enough

#: What separates words once A-Z are a-z; A-Z are words before that, too.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
ANCHORS = 2
#: Words of an anchor's distance that ``proximity`` forgives.
SLOP = 3
#: Rows of test items, and of candidates, counted to be at most so many are broadcast.
BROADCAST_ROWS = 200_000


def _words(text: str = "text") -> Column:
    return words(lower_ascii(F.col(text)), _BETWEEN)


def _keys() -> list[Column]:
    """What identifies a document: id and text hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("k")]


@dataclass(frozen=True)
class PositionalIndex:
    """A stored index: ``postings`` (word, d, k, pos) sorted by the word's hash within each file, and ``lexicon`` (word, n)."""

    postings: DataFrame
    lexicon: DataFrame

    def documents(self) -> DataFrame:
        """d, k, n_words of every document with words."""
        return self.postings.where("word = ''").select("d", "k", F.col("pos").cast("long").alias("n_words")).distinct()


def open_index(spark: SparkSession, path: str) -> PositionalIndex:
    """An index that was built before."""
    postings = spark.read.schema("word string, d long, k long, pos int").parquet(f"{path}/postings")
    return PositionalIndex(postings, spark.read.schema("word string, n long").parquet(f"{path}/lexicon"))


def index_rows(docs: DataFrame) -> DataFrame:
    """word, d, k, pos: what a task writes of its documents, by word."""
    found = docs.select(*_keys(), F.concat(_words(), F.array(F.lit(""))).alias("words"))
    # A filter on the words, such as Spark puts before an inner posexplode, would make them twice.
    each = found.select("d", "k", F.posexplode_outer("words").alias("pos", "word")).where("pos > 0 or word <> ''")
    # Sorted by one number, rows are not compared; those of a word mostly stay in the order of the texts.
    return each.select("word", "d", "k", "pos").sortWithinPartitions(F.xxhash64("word"))


def build_index(docs: DataFrame, path: str) -> PositionalIndex:
    """Writes the index of ``docs`` into ``path``."""
    index_rows(docs).write.parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings").where("word <> ''")
    written.groupBy("word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/lexicon")
    return open_index(docs.sparkSession, path)


def items(benchmark: DataFrame) -> DataFrame:
    """i, item_id, words: the test items that have words."""
    found = benchmark.where("item_id is not null").select("item_id", _words().alias("words")).where("size(words) > 0").distinct()
    return found.select(F.xxhash64("item_id", "words").alias("i"), "item_id", "words")


def anchored(tests: DataFrame, index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """The items with ``rare``: for each window that can occur, the places of its rarest words."""
    vocabulary = materialize(tests.select(F.explode("words").alias("word")).distinct(), "test-words")
    seen = index.lexicon.join(maybe_broadcast(vocabulary, BROADCAST_ROWS), "word")
    placed = tests.select("i", F.posexplode("words").alias("at", "word")).join(seen, "word", "left")
    counts = placed.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    rare = f"""transform(sequence(0, greatest(size(places) - {window}, 0)),
      w -> slice(array_sort(transform(slice(places, w + 1, {window}), p -> struct(p.n as n, p.at as at))), 1, {ANCHORS}))"""
    usable = f"transform(filter({rare}, r -> r[0].n > 0), r -> transform(r, x -> x.at))"
    return tests.join(counts.select("i", F.expr(usable).alias("rare")), "i").where("size(rare) > 0")


def postings(index: PositionalIndex, anchors: DataFrame) -> DataFrame:
    """d, k, pos, i, at: the postings of the anchor words, with the places of items that have them."""
    each = anchors.select("i", "words", F.explode(F.array_distinct(F.flatten("rare"))).alias("at")).select(F.expr("words[at]").alias("word"), F.struct("i", "at").alias("place"))
    places = materialize(each.groupBy("word").agg(F.collect_list("place").alias("places")).join(index.lexicon, "word"), "anchor-words")
    if small_enough(places, BROADCAST_ROWS):
        met = index.postings.join(F.broadcast(places), "word")
    else:
        met = join_counted(index.postings, places, "word", "n", index.lexicon.agg(F.sum("n")).first()[0] or 0)
    return met.select("d", "k", "pos", F.explode("places").alias("p")).select("d", "k", "pos", "p.i", "p.at")


def diagonals(index: PositionalIndex, anchors: DataFrame) -> DataFrame:
    """d, k, i, diagonal where the anchors of a window meet."""
    met = postings(index, anchors).select("d", "k", "i", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    # A group has at most the item's places.
    lists = met.groupBy("d", "k", "i", "diagonal").agg(F.collect_set("at").alias("at"))
    rare = anchors.select("i", "rare", F.expr("array_min(transform(rare, r -> size(r)))").alias("least"))
    # Most diagonals have one anchor, too few for any window of most items.
    met_by = lists.join(maybe_broadcast(materialize(rare, "rare"), BROADCAST_ROWS), "i").where("size(at) >= least")
    return met_by.where("exists(rare, r -> size(array_except(r, at)) = 0)").select("d", "k", "i", "diagonal")


def exact_matches(index: PositionalIndex, found: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, k, item_id, diagonal, n (words of a window), starts: where an item's windows occur.

    The postings that a candidate lacks are looked up by document, word and position,
    so each finds one row at most. Many are looked up through filters of a fixed size, so
    the index stays where it is.
    """
    wanted = found.join(tests.select("i", "words"), "i").select("d", "k", "i", "diagonal", F.posexplode("words").alias("at", "word"))
    wanted = materialize(wanted.select("d", "k", "word", (F.col("diagonal") + F.col("at")).alias("pos"), "i", "diagonal", "at").where("pos >= 0"), "wanted-postings")
    places = wanted.groupBy("d", "k", "word", "pos").agg(F.collect_set(F.struct("i", "diagonal", "at")).alias("places"))
    if small_enough(wanted, BROADCAST_ROWS):
        there = index.postings.join(F.broadcast(places), ["d", "k", "word", "pos"])
    else:
        some = materialize(wanted.select("d", "k").distinct(), "candidate-documents")
        near = index.postings.join(F.broadcast(some), ["d", "k"], "left_semi") if small_enough(some, BROADCAST_ROWS) else possible_rows(index.postings, ["d", "k"], some)
        # Of the candidates' postings only those at wanted places are shuffled.
        there = possible_rows(near, ["d", "k", "pos"], wanted).join(places, ["d", "k", "word", "pos"])
    each = there.select("d", "k", F.explode("places").alias("p")).groupBy("d", "k", "p.i", "p.diagonal").agg(F.sort_array(F.collect_set("p.at")).alias("at"))
    sized = each.join(tests.select("i", "item_id", F.least(F.size("words"), F.lit(window)).alias("n")), "i")
    return sized.select("d", "k", "item_id", "diagonal", "n", F.expr("filter(at, (x, j) -> get(at, j + n - 1) = x + n - 1)").alias("starts")).where("size(starts) > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index: PositionalIndex | None = None) -> DataFrame:
    """doc_id, d, k, n_words, n_hit, item_ids of every row; ``index`` is that of ``docs``, which is built otherwise."""
    tests = materialize(items(benchmark), "items")
    index = index or build_index(docs, new_path(docs.sparkSession, "positional-index"))
    anchors = materialize(anchored(tests, index, window), "anchored")
    found = materialize(diagonals(index, anchors), "diagonals")
    places = "array_distinct(flatten(flatten(collect_list(transform(starts, s -> sequence(diagonal + s, diagonal + s + n - 1))))))"
    hits = exact_matches(index, found, tests, window).groupBy("d", "k").agg(F.expr(f"cast(size({places}) as long)").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    known = index.documents().join(maybe_broadcast(materialize(hits, "hits"), BROADCAST_ROWS), ["d", "k"], "left")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys()).join(known, ["d", "k"], "left")
    none = F.lit(0).cast("long")
    return rows.select("doc_id", "d", "k", F.coalesce("n_words", none).alias("n_words"), F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, window: int = WINDOW, index: PositionalIndex | None = None) -> DataFrame:
    """doc_id, item_id, n: pairs of anchors of a window that lie within ``slop`` words of their distance in the item.

    Diagonals are cut into buckets of slop + 1, so each posting meets only those in
    its own and the two next buckets.
    """
    tests = materialize(items(benchmark), "items")
    index = index or build_index(docs, new_path(docs.sparkSession, "positional-index"))
    anchors = materialize(anchored(tests, index, window), "anchored")
    windows = anchors.select("i", F.explode("rare").alias("r")).where("size(r) > 1").distinct()
    met = materialize(postings(index, anchors).distinct(), "anchor-postings")

    def side(n: int) -> DataFrame:
        mine = windows.select("i", "r", F.expr(f"r[{n}]").alias("at"))
        return met.join(maybe_broadcast(materialize(mine, "windows"), BROADCAST_ROWS), ["i", "at"]).select("d", "k", "i", "r", (F.col("pos") - F.col("at")).alias(f"diagonal{n}"))

    left = side(0).withColumn("bucket", F.floor(F.col("diagonal0") / (slop + 1)))
    right = side(1).withColumn("bucket", F.explode(F.expr(f"sequence(floor(diagonal1 / {slop + 1}) - 1, floor(diagonal1 / {slop + 1}) + 1)")))
    near = left.join(right, ["d", "k", "i", "r", "bucket"]).where(F.abs(F.col("diagonal0") - F.col("diagonal1")) <= slop)
    counted = near.groupBy("d", "k", "i").agg(F.count(F.lit(1)).alias("n")).join(tests.select("i", "item_id"), "i")
    return counted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys()), ["d", "k"]).select("doc_id", "item_id", "n")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    return without_rows(docs, _keys(), contamination(docs, benchmark, window).where("n_hit > 0").select("d", "k"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda i: array_to_string(w[i+1:i+10], ' '))) AS s
  FROM b WHERE len(w) > 0),
dp AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM w, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
h AS (SELECT DISTINCT doc_id, item_id, p, bw.l FROM dp JOIN bw ON dp.l = bw.l AND array_to_string(dp.w[p+1:p+dp.l], ' ') = bw.s),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
