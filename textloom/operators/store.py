"""A chunk store on Parquet, and caches with a time to live.

A collection is a log: every upsert and every deletion adds its own rows and touches
nothing that is stored. What it holds is, for each key, the newest row that no later
deletion names. An addition is written into folders of its own and counts once it has got a
number: the first writer to create the number's file has it (an atomic step where files
can be created exclusively), and others take the next one. So writers at work at the same
time lose nothing, and what a failed one left behind has no number. Who
rewrites what it has read, as ``compact`` does, gives the last number that it knows; if another
writer was faster, it is told so and begins again.

Each addition has a small Bloom filter of its documents' ids. ``existing`` asks the filters
first, and opens only additions that may hold one of the ids asked for.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.storage import materialize


def upserted(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``incoming`` added, or put in the place of those with their key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def new_documents(incoming: DataFrame, stored: DataFrame, key: str = "doc_id", force: bool = False) -> DataFrame:
    """What is not stored yet, once per key; everything when forced."""
    once = incoming.dropDuplicates([key])
    return once if force else once.join(stored.select(key).distinct(), key, "left_anti")


def without_documents(stored: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def collection_stats(chunks: DataFrame, by: str = "collection") -> DataFrame:
    """Chunks, documents, tokens and least confidence of each collection."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum("token_count").alias("tokens"), F.min("confidence").alias("min_confidence"))


def page_counts(elements: DataFrame) -> DataFrame:
    """doc_id, page_count: the largest page, 1 where none is known."""
    return elements.groupBy("doc_id").agg(F.coalesce(F.max("page"), F.lit(1)).alias("page_count"))


def cache_lookup(asked: DataFrame, cached: DataFrame, now: Column) -> DataFrame:
    """``asked`` (key, ...) with value and hit; entries (key, value, expires_at) that are over do not count."""
    alive = cached.where(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", "expires_at").alias("value"))
    return asked.join(alive, "key", "left").withColumn("hit", F.col("value").isNotNull())


def fill_cache(asked: DataFrame, cached: DataFrame, now: Column, compute, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Values for every row of ``asked`` in its order column, and the new entries.

    ``compute`` gets the missing keys once each and adds a column value; keys for which
    it gives none drop out.
    """
    found = cache_lookup(asked, cached, now)
    missing = found.where("not hit").drop("value", "hit").dropDuplicates(["key"])
    made = compute(missing).where("value is not null")
    entries = made.select("key", "value", (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    misses = found.where("not hit").drop("value", "hit").join(entries.select("key", "value"), "key")
    return found.where("hit").drop("hit").unionByName(misses.select(*[c for c in found.columns if c != "hit"])), entries


def invalidate(cached: DataFrame, gone: DataFrame) -> DataFrame:
    """Result-cache entries (key, doc_ids, ...) that touch none of the documents in ``gone``."""
    hit = cached.select("key", F.explode("doc_ids").alias("doc_id")).join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("key").distinct()
    return cached.join(hit, "key", "left_anti")


class ConcurrentWriteError(RuntimeError):
    """Another writer has added to a log since it was read."""


@dataclass
class Log:
    """Tables of a folder to which rows are only added, each addition under a number ``n``."""

    spark: SparkSession
    path: str

    def steps(self) -> DataFrame:
        """addition, n of all additions that count."""
        try:
            rows = self.spark.read.text(f"{self.path}/steps").select(F.col("value").alias("addition"), F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)$", 1).cast("long").alias("n"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], "addition string, n long")
        return rows

    def last(self) -> int:
        return self.steps().agg(F.max("n")).first()[0] or 0

    def rows(self, name: str, schema: str) -> DataFrame:
        """The rows of all additions, whether they count or not, with the addition's name; a condition on it skips whole folders."""
        schema = f"{schema}, addition string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, name: str, schema: str) -> DataFrame:
        """The rows of the additions that count by now, with their numbers."""
        return self.table_with_names(name, schema).where(F.col("n") <= self.last()).drop("addition")

    def table_with_names(self, name: str, schema: str) -> DataFrame:
        """The rows of the additions that count, with their names and numbers."""
        return self.rows(name, schema).join(F.broadcast(self.steps()), "addition")

    def add(self, seen: int | None = None, **tables: DataFrame) -> int:
        """Adds rows to some tables at once; returns their number. With ``seen``, the last number known, nothing may have been added since."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(f"{self.path}/{table}/addition={name}")
        n = (self.last() if seen is None else seen) + 1
        while not self._claim(n, name):
            if seen is not None:
                raise ConcurrentWriteError(f"number {n} is taken")
            n += 1
        return n

    def _claim(self, n: int, name: str) -> bool:
        """Whether this addition got the number: only one can create its file."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/steps/{n:012d}")
        try:
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        out.write(name.encode())
        out.close()
        return True


#: Bits of a document's place in a filter, and of the filter for each document.
_PROBES, _BITS = 4, 16


def _filter_rows(ids: DataFrame, column: str, words: int) -> DataFrame:
    """word, bits, words: a Bloom filter whose probes of an id lie in one word of 64 bits."""
    return ids.groupBy(_word(F.col(column), words).alias("word")).agg(F.bit_or(_pattern(F.col(column))).alias("bits")).withColumn("words", F.lit(words))


def _word(value: Column, words: int | Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(words) if isinstance(words, int) else words)


def _pattern(value: Column) -> Column:
    h = F.xxhash64(F.lit(1), value)
    found = F.lit(0).cast("long")
    for i in range(_PROBES):
        found = found.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")))
    return found


@dataclass
class Collection:
    """A named collection of chunks in a folder; ``key`` tells chunks apart, ``document`` names what deletions go by."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "chunk_id"
    document: str = "doc_id"

    @property
    def _log(self) -> Log:
        return Log(self.spark, self.path)

    @property
    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _start(self) -> int:
        return self._log.table("starts", "id long").agg(F.max("n")).first()[0] or 0

    def _gone(self, start: int) -> DataFrame:
        return self._log.table("gone", f"{self.document} string").where(F.col("n") >= start).groupBy(self.document).agg(F.max("n").alias("last"))

    def read(self) -> DataFrame:
        start = self._start()
        rows = self._log.table("rows", self.schema).where(F.col("n") >= start)
        there = rows.join(self._gone(start), self.document, "left").where("last is null or n > last")
        newest = F.max_by(F.struct(*self._columns), F.col("n")).alias("row")
        return there.groupBy(self.key).agg(newest).select("row.*")

    def _add_rows(self, chunks: DataFrame, seen: int | None = None, **more: DataFrame) -> None:
        rows = materialize(chunks.select(*self._columns), "new-chunks")
        ids = rows.select(F.col(self.document).cast("string").alias("id")).distinct()
        words = max(1, ids.count() * _BITS // 64)
        self._log.add(seen, rows=rows, filters=_filter_rows(ids, "id", words).select("word", "bits", F.col("words").cast("long").alias("words")).coalesce(1), **more)

    def upsert(self, chunks: DataFrame) -> None:
        """Adds chunks, or puts them in the place of those with their keys."""
        self._add_rows(chunks)

    def delete(self, gone: DataFrame) -> None:
        """Takes out all chunks of the documents in ``gone``."""
        self._log.add(gone=gone.select(F.col(self.document).cast("string").alias(self.document)).distinct())

    def clear(self) -> None:
        self._log.add(starts=self.spark.range(1))

    def compact(self) -> None:
        """Writes what the collection holds once more, as its new beginning; fails if another writer adds to it meanwhile."""
        seen = self._log.last()
        self._add_rows(self.read(), seen, starts=self.spark.range(1))

    def additions_with(self, ids: DataFrame) -> list[str]:
        """Names of the additions whose filters do not rule out all ``ids`` (id, string)."""
        known = self._log.table_with_names("filters", "word long, bits long, words long")
        sizes = known.select("words").distinct()
        asked = ids.crossJoin(F.broadcast(sizes)).select("words", _word(F.col("id"), F.col("words")).alias("word"), _pattern(F.col("id")).alias("wanted"))
        hits = known.join(asked, ["words", "word"]).where(F.col("bits").bitwiseAND(F.col("wanted")) == F.col("wanted"))
        return [r.addition for r in hits.select("addition").distinct().collect()]

    def existing(self, ids: DataFrame) -> DataFrame:
        """The ``ids`` (id, string) of documents that the collection holds, for documents whose chunks have keys of their own.

        Only additions that may hold them are opened. Their names come to the driver, not their rows.
        """
        names, start = self.additions_with(ids), self._start()
        rows = self._log.rows("rows", f"{self.document} string").where(F.col("addition").isin(names)).join(F.broadcast(self._log.steps()), "addition").where(F.col("n") >= start)
        found = rows.select(F.col(self.document).alias("id"), "n").join(ids.distinct(), "id", "left_semi").groupBy("id").agg(F.max("n").alias("n"))
        gone = self._gone(start).select(F.col(self.document).alias("id"), "last")
        return found.join(gone, "id", "left").where("last is null or n > last").select("id")
