"""Rows picked out of a table, or given a value, by keys that another table has.

The keys are columns under names that the table has not got, so its own columns, whatever
their names, pass through as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import materialize, small_enough

#: Keys counted to be at most so many are broadcast.
BROADCAST_ROWS = 200_000
#: Words of 64 bits of the filter that is broadcast where the keys are more.
FILTER_WORDS = 1 << 20


def fresh_names(df: DataFrame, n: int, *others: DataFrame) -> list[str]:
    """``n`` column names that none of the tables has, in upper or lower case."""
    taken = {c.lower() for table in (df, *others) for c in table.columns}
    out: list[str] = []
    i = 0
    while len(out) < n:
        if f"_key{i}" not in taken:
            out.append(f"_key{i}")
        i += 1
    return out


def _keyed(docs: DataFrame, keys: Sequence[Column], found: DataFrame) -> tuple[DataFrame, DataFrame, Column, list[str], list[str]]:
    """Both sides with fresh names, the condition that their keys are equal (nulls are), the names of the left and of the right side."""
    names = fresh_names(docs, len(keys) + len(found.columns))
    left, right = names[: len(keys)], names[len(keys) :]
    return docs.withColumns(dict(zip(left, keys, strict=True))), found.toDF(*right), reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=False))), left, right


def _place(names: list[str]) -> Column:
    """The filter's word for a key."""
    return F.pmod(F.xxhash64(*names), F.lit(FILTER_WORDS))


def _pattern(names: list[str]) -> Column:
    """Three bits of a word, from a second hash."""
    h = F.xxhash64(F.lit(1), *names)
    return reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(3)))


def _filter(keyed: DataFrame, names: list[str], word: str, bits: str) -> DataFrame:
    """A Bloom filter of the keys: at most FILTER_WORDS rows of two numbers."""
    return materialize(keyed.groupBy(_place(names).alias(word)).agg(F.bit_or(_pattern(names)).alias(bits)), "filter")


def possible_rows(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose ``keys`` are in ``wanted``, and few others; the filter is broadcast and no row is moved.

    The keys are columns of both tables, of the same types.
    """
    word, bits = fresh_names(rows, 2, wanted)
    marked = rows.withColumn(word, _place(keys)).join(F.broadcast(_filter(wanted, keys, word, bits)), word)
    return marked.where(F.col(bits).bitwiseAND(_pattern(keys)) == _pattern(keys)).drop(word, bits)


def without_rows(docs: DataFrame, keys: Sequence[Column], gone: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are in no row of ``gone``, which has them in this order.

    Few keys are broadcast. Of many, a Bloom filter of a fixed size is built by Spark and broadcast: rows
    that it rules out stay where they are, and only the others are shuffled to the keys.
    """
    gone = materialize(gone.distinct(), "rows-that-go")
    left_side, right_side, same, left, right = _keyed(docs, keys, gone)
    if small_enough(gone, broadcast_rows):
        return left_side.join(F.broadcast(right_side), same, "left_anti").drop(*left)
    word, bits = fresh_names(docs, len(left) + len(right) + 2)[-2:]
    held = _filter(right_side, right, word, bits)
    marked = left_side.withColumn(word, _place(left)).join(F.broadcast(held), word, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(_pattern(left)) == _pattern(left), F.lit(False))
    doubtful = marked.where(maybe).drop(word, bits).join(right_side, same, "left_anti")
    return marked.where(~maybe).drop(word, bits, *left).unionByName(doubtful.drop(*left))


def with_value(docs: DataFrame, keys: Sequence[Column], found: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, list[str]]:
    """``docs`` with the last column of ``found``, which begins with the keys, null where it has none, and the names of the columns added, the value's last."""
    found = materialize(found, "values")
    left_side, right_side, same, left, right = _keyed(docs, keys, found)
    side = F.broadcast(right_side) if small_enough(found, broadcast_rows) else right_side
    return left_side.join(side, same, "left"), [*left, *right]
