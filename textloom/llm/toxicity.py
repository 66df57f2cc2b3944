"""Toxicity scores from positive-unlabelled learning with a non-negative risk.

Labelled toxic rows are the confirmed positives. All other training text counts as
unlabelled: its labels are not shown to the learner, which may itself hold toxic
rows. For a linear scorer f, loss l and class prior p, the risk is

    p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])

The second part estimates the risk on the negatives by correcting the unlabelled
rows for the positives among them, and is kept from going below zero, which a
flexible scorer would otherwise fit to (Kiryo et al., 2017).

A text's features are its words (letters and digits, A-Z as a-z) and their
beginnings, each by how often it occurs (at least TIERS times). A feature enters
the model when its share among the positives exceeds that among the unlabelled
texts beyond doubt; Spark counts the shares over all training rows. Copies of a text
count once there. Only the weights are fitted on a bounded sample of the labelled
rows (SAMPLE), in numpy; a feature that no sampled text has keeps a weight of 0.
Everything else covers all rows. Scoring is one pass without a shuffle; the model
that it broadcasts has at most FEATURES words.

Defined results: a null or empty text has no words and scores as the bias alone;
rows that repeat get the same score; labels that are null, or of unknown documents,
are left out; of several labels of a doc_id the highest counts. With no positive
or no unlabelled row to learn from, every score is the prior. A null doc_id is
not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.wordhash import PUNCTUATION, blocks
from textloom.storage import materialize, maybe_broadcast, read_table

#: At most so many positive and so many unlabelled rows are used to fit the weights.
SAMPLE = (5_000, 12_000)
#: At most so many words and beginnings have weights.
FEATURES = 512
#: Bytes of a beginning; occurrences in a text from which another weight counts.
BEGINNINGS = (5, 6, 7, 8)
TIERS = (1, 2, 4)
THRESHOLD = 0.7
#: A feature's lead in standard errors, and the positives that have it, at least.
LEAD, SUPPORT = 5.0, 5
#: Training texts counted to be at most so many are found by a broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Model:
    """Hashed words and beginnings (ascending), their weights by tier, and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def occurrences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By block: index of the first text, texts, and owner and hash of every word and beginning."""
    for i, n, words in blocks(texts, fold=True, ends_word=PUNCTUATION):
        owner = np.repeat(np.arange(n), np.diff(words.first))
        parts, owners = [words.hashes], [owner]
        for size in BEGINNINGS:
            long = words.end - words.start > size
            parts.append(words.prefixes(long, size))
            owners.append(owner[long])
        yield i, n, np.concatenate(owners), np.concatenate(parts)


def tallies(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, feature and count of each pair that occurs, by owner and feature."""
    order = np.lexsort((feature, owner))
    o, f = owner[order], feature[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], f[at], np.diff(np.append(at, len(f)))


def found_in(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in ``words`` and count of the chosen features that occur in a batch."""
    near = np.zeros(1 << 16, bool)
    near[words & np.uint64(0xFFFF)] = True
    out = []
    for i, _, owner, feature in occurrences(texts):
        maybe = near[feature & np.uint64(0xFFFF)]
        owner, feature = owner[maybe], feature[maybe]
        at = np.minimum(np.searchsorted(words, feature), max(0, len(words) - 1))
        hit = words[at] == feature if len(words) else np.zeros(0, bool)
        o, f, n = tallies(owner[hit] + i, at[hit])
        out.append((o, f, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """id, toxic of every document that is learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """text, positive, unlabelled of all training rows without copies, and the sums of both marks.

    Ids and digests settle which row stands for a text; texts stay where they are
    while those rows are few enough to broadcast, and move once otherwise. Rows that
    repeat an id and its text are the only ones that are grouped with their text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.unhex(F.md5("text")).alias("digest")).where("text is not null")
    found = texts.drop("text").join(training_labels(labels), "id").groupBy("digest", "id").agg(F.max("toxic").alias("toxic"), F.count(F.lit(1)).alias("copies"))
    first = found.groupBy("digest").agg(F.max("toxic").alias("positive"), F.min(F.struct("id", "copies")).alias("first"))
    first = materialize(first.select("digest", "first.id", "first.copies", "positive"), "training-texts")
    positive, unlabelled, most = first.agg(F.sum("positive"), F.count(F.lit(1)), F.max("copies")).first()
    rows = texts.join(maybe_broadcast(first, BROADCAST_ROWS), ["id", "digest"])
    if (most or 0) > 1:
        again = rows.where("copies > 1").groupBy("digest").agg(F.first("text").alias("text"), F.max("positive").alias("positive"))
        rows = rows.where("copies = 1").select("text", "positive").unionByName(again.select("text", "positive"))
    return rows.select("text", "positive", F.lit(1).alias("unlabelled")), (positive or 0, unlabelled)


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, float]:
    """text, positive, unlabelled of the sampled rows without copies, and the class prior.

    The sample is the rows with the smallest hashes of doc_id: the same at every run
    and independent of all else. The prior comes from all training labels.
    """
    known = training_labels(labels)
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("id")
    positive = known.where("toxic = 1").orderBy(order).limit(sample[0]).select("id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    unlabelled = known.orderBy(order).limit(sample[1]).select("id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    chosen = positive.unionByName(unlabelled).groupBy("id").agg(F.max("p").alias("positive"), F.max("u").alias("unlabelled"))
    # At most sum(sample) ids are broadcast, whatever the corpus.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").where("text is not null")
    return rows.groupBy("text").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled")), float(prior)


def choose(rows: DataFrame, n: tuple[int, int], features: int = FEATURES) -> np.ndarray:
    """Hashes of the words and beginnings that lead among the positives, ascending.

    ``n`` is the number of positive and of unlabelled rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.asarray(batch[c]) for c in ("positive", "unlabelled")]
            for i, _, owner, feature in occurrences(batch["text"]):
                o, f, n = tallies(owner, feature)
                tier = np.searchsorted(TIERS, n, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(tier), *(pa.array(m[o + i]) for m in marks)], ["feature", "tier", "p", "u"])

    if not n[0] or not n[1]:
        return np.zeros(0, np.uint64)
    each = rows.mapInArrow(task, "feature long, tier long, p int, u int").groupBy("feature").agg(*(F.sum(F.when(F.col("tier") >= t, F.col(c))).alias(f"{c}{t}") for t in range(len(TIERS)) for c in "pu"))

    def lead(t: int) -> Column:
        p, u = F.coalesce(F.col(f"p{t}"), F.lit(0)), F.coalesce(F.col(f"u{t}"), F.lit(0))
        spread = F.sqrt(F.greatest(u, F.lit(1)) / n[1] * (1 / n[0] + 1 / n[1]))
        return F.when(p >= SUPPORT, (p / n[0] - u / n[1]) / spread).otherwise(F.lit(0.0))

    best = each.select("feature", F.greatest(*map(lead, range(len(TIERS)))).alias("lead")).where(F.col("lead") > LEAD)
    # At most ``features`` rows reach the driver.
    return np.sort(np.array([r.feature for r in best.orderBy(F.desc("lead"), "feature").limit(features).collect()], np.int64).view(np.uint64))


def design(rows: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample as a sparse 0-1 matrix (row and column of each one), and its two marks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, f, n = found_in(batch["text"], words)
            column = np.concatenate([f[n >= t] * len(TIERS) + k for k, t in enumerate(TIERS)])
            owner = np.concatenate([o[n >= t] for t in TIERS])
            order = np.lexsort((column, owner))
            first = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(column[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["positive"], batch["unlabelled"], lists], ["p", "u", "columns"])

    # At most sum(SAMPLE) rows with a few numbers each.
    got = rows.mapInArrow(task, "p int, u int, columns array<int>").toArrow()
    lists = got["columns"].combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    return owner, np.asarray(lists.flatten()), np.asarray(got["p"]).astype(bool), np.asarray(got["u"]).astype(bool)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(owner: np.ndarray, column: np.ndarray, p: np.ndarray, u: np.ndarray, size: int, prior: float, epochs: int = 600, rate: float = 0.05, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with l(z) = log(1 + exp(-z)); by Adam."""
    w, b = np.zeros(size), -1.0
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, epochs + 1):
        f = np.clip(_sigmoid(np.bincount(owner, w[column], minlength=len(p)) + b), 1e-7, 1 - 1e-7)
        on = np.zeros(len(p))
        if np.log1p(-f[u]).mean() <= prior * np.log1p(-f[p]).mean():
            on[u] += f[u] / u.sum()
            on[p] -= prior / p.sum()
        else:
            # The part on the negatives is below zero: it alone is driven back up.
            on[u] -= f[u] / u.sum()
            on[p] += prior * f[p] / p.sum()
        slope = np.append(np.bincount(column, on[owner], minlength=size) + decay * w, on.sum())
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Score of each text of a batch."""
    o, f, n = found_in(texts, model.words)
    weights = np.zeros(len(f))
    for k, t in enumerate(TIERS):
        weights += np.where(n >= t, model.weights[f * len(TIERS) + k], 0.0) if len(f) else 0.0
    return _sigmoid(np.bincount(o, weights, minlength=len(texts)) + model.bias) if len(f) else np.full(len(texts), _sigmoid(np.array(model.bias)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores(batch["text"], sent.value))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, features: int = FEATURES) -> Model:
    words = choose(*training_texts(docs, labels), features)
    rows, prior = training_rows(docs, labels, sample)
    if not len(words) or not 0 < prior < 1:
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(words[:0], np.zeros(0), float(np.log(prior / (1 - prior))))
    return Model(words, *fit(*design(rows, words), len(words) * len(TIERS), prior))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Texts are scored where they are, so no row is moved.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch[at], sent.value) < threshold))

    # Columns go by their places, as names may need quotes.
    at = docs.columns.index("text")
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return placed.mapInArrow(task, placed.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
