"""Equi-joins in which a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most HOT_PARTS keys are.
HOT_PARTS = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key`` and the key's rows in ``count``.

    ``total`` is the number of rows that the counts add up to. A key with over
    total / HOT_PARTS rows is hot; there are fewer than HOT_PARTS of them whatever
    the input, so they are broadcast and their rows stay where they are. All other
    keys meet in an ordinary shuffled join. Null keys match nothing. ``how`` is
    inner or left.
    """
    keys = [key] if isinstance(key, str) else key
    bound = max(1, total // HOT_PARTS)
    is_hot = F.col(count) > bound
    names = [*left.columns, *(c for c in right.columns if c not in keys)]
    from_hot = left.join(F.broadcast(right.where(is_hot)), keys)
    rest = left.join(F.broadcast(right.where(is_hot).select(*keys)), keys, "left_anti")
    return from_hot.select(*names).unionByName(rest.join(right.where(~is_hot), keys, how).select(*names))
