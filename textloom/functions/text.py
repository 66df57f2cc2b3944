"""Built-in text expressions whose results do not depend on a language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that lower() would change although they are not A-Z.
_OTHER_CAPITALS = r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^A-Z]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, every other character as it is.

    ``lower`` does the same, several times as fast as ``translate``, on a text without
    other capitals.
    """
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def head(text: Column, limit: int | None) -> Column:
    """The first ``limit`` characters, or the whole text."""
    return text if limit is None else F.substring(text, 1, limit)


def words(text: Column, between: str = WHITE) -> Column:
    """The non-empty pieces between matches of a regular expression; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"^{WHITE}|{WHITE}$", "")


def token_count(text: Column, counter: Callable[[Column], Column] | None = None) -> Column:
    """White-space words, or what another ``counter`` of texts says; 0 for null and empty texts."""
    if counter is None:
        return F.size(words(text))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(counter(text)).cast("int")


def truncate_tokens(text: Column, n: int, from_end: bool = False) -> Column:
    """The first (or last) n words, joined by one space."""
    found = words(text)
    return F.array_join(F.when(F.size(found) <= n, found).otherwise(F.slice(found, -n if from_end else 1, n)), " ")


def document_id(content: Column) -> Column:
    """Identity of a document's bytes."""
    return F.sha2(content, 256)


def cache_key(model: Column, text: Column) -> Column:
    """Key of a cached embedding."""
    return F.concat(F.lit("emb:"), F.sha2(F.concat(model, F.lit(":"), text), 256))


def entity_id(name: Column) -> Column:
    """Lower case, spaces as underscores, 64 characters at most."""
    return F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, 64)


def relation_name(name: Column) -> Column:
    """Upper case, spaces and hyphens as underscores."""
    return F.translate(F.upper(name), " -", "__")
