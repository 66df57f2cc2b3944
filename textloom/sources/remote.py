"""Documents by URL: a table of addresses fetched by tasks, or a stated list as a data source.

Every address gives a row, also one that cannot be had: ``error`` then says why, and the
job goes on. Redirects are followed, to http and https only; answers that may pass (408,
425, 429, 5xx) and broken connections are tried again after growing pauses.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions.text import document_id
from textloom.sources.files import file_format

FETCHED = "url string, final_url string, status int, content binary, error string"
_NAMES = [x.split()[0] for x in FETCHED.split(", ")]
#: Answers after which the same request may do better.
PASSING = {408, 425, 429, 500, 502, 503, 504}
#: Addresses that a list given as an option may hold; longer lists are tables.
MAX_LISTED = 10_000


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = 10

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not newurl.lower().startswith(("http://", "https://")):
            raise urllib.error.HTTPError(newurl, code, "redirected to what is no web address", headers, fp)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def get(url: str | None, seconds: float = 60, tries: int = 3, pause: float = 1, max_bytes: int = 1 << 28) -> tuple:
    """url, final_url, status, content, error. An answer of over ``max_bytes`` is an error, never a part of it."""
    if url is None or not url.lower().startswith(("http://", "https://")):
        return url, None, None, None, "no web address"
    status = final = None
    error = "not tried"
    for n in range(tries):
        if n:
            time.sleep(pause * 2 ** (n - 1))
        try:
            with urllib.request.build_opener(_Redirects).open(url, timeout=seconds) as answer:
                status, final, content = answer.status, answer.url, answer.read(max_bytes + 1)
                if len(content) > max_bytes:
                    return url, final, status, None, f"over {max_bytes} bytes"
                return url, final, status, content, None
        except urllib.error.HTTPError as e:
            status, final, error = e.code, e.url, str(e)
            e.close()
            if status not in PASSING:
                break
        except (OSError, http.client.HTTPException) as e:
            status, error = None, str(e) or type(e).__name__
        except ValueError as e:
            return url, None, None, None, str(e)
    return url, final, status, None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def fetch(urls: DataFrame, column: str = "url", tasks: int | None = None, seconds: float = 60, tries: int = 3, pause: float = 1, max_bytes: int = 1 << 28) -> DataFrame:
    """FETCHED for every row of a table of addresses; one answer is held at a time.

    Equal addresses are asked for once and give one row, as does null. Addresses are dealt by their hash, so
    those of one host are spread; ``tasks`` bounds the connections that are open at once. A repeated task
    asks again, so store what this returns before it is used twice.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield _batch([get(url, seconds, tries, pause, max_bytes)])

    named = urls.select(F.col(f"`{column}`").cast("string").alias("url")).distinct()
    dealt = named.repartition(tasks, "url") if tasks else named.repartition("url")
    return dealt.mapInArrow(task, FETCHED)


def as_documents(fetched: DataFrame) -> DataFrame:
    """What was fetched, as ``files.load`` gives it: doc_id (of the bytes), source_file, format, content. Errors are left out."""
    return fetched.where("content is not null").select(document_id(F.col("content")).alias("doc_id"), F.col("url").alias("source_file"), file_format(F.coalesce("final_url", "url"), F.col("content")).alias("format"), "content")


class _Listed(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], per_task: int, how: dict):
        self.urls, self.per_task, self.how = urls, per_task, how

    def partitions(self) -> list[InputPartition]:
        return [_Listed(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)] or [_Listed([])]

    def read(self, partition: _Listed) -> Iterator[pa.RecordBatch]:
        for url in partition.urls:
            yield _batch([get(url, **self.how)])


class UrlSource(DataSource):
    """``spark.read.format("web_documents")`` with ``urls`` (one a line), ``per_task``, ``seconds``, ``tries``, ``pause``, ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "web_documents"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        urls = list(dict.fromkeys(u for u in map(str.strip, self.options.get("urls", "").splitlines()) if u))
        if len(urls) > MAX_LISTED:
            raise ValueError(f"over {MAX_LISTED} addresses: fetch() takes a table of them")
        kinds = {"seconds": float, "tries": int, "pause": float, "max_bytes": int}
        return _Reader(urls, int(self.options.get("per_task", 16)), {k: kind(self.options[k]) for k, kind in kinds.items() if k in self.options})
