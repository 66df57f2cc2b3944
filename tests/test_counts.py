"""Words counted within rows, and hashed together."""

from pyspark.sql import functions as F

from textloom.functions.hashing import murmur3, murmur3_all
from textloom.operators import retrieval, safety


def test_words_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "COUNTED_ROWS", 2)
    rows = [(1, "B a\tb\x0bÄ ä\xa0x c b"), (2, None), (3, " \n"), (None, "q q r"), (4, "a"), (5, "x\x1cy z")]
    df = spark.createDataFrame(rows, "id long, text string")
    found = retrieval.token_weights(df, "id")
    got = {(r.id, r.token, r.tf, r.weight) for r in found.collect()}
    want = {(1, "b", 3, 1.0), (1, "a", 1, 1 / 3), (1, "ä", 1, 1 / 3), (1, "ä\xa0x", 1, 1 / 3), (1, "c", 1, 1 / 3), (None, "q", 2, 1.0), (None, "r", 1, 0.5), (4, "a", 1, 1.0), (5, "x\x1cy", 1, 1.0), (5, "z", 1, 1.0)}
    assert got == want
    # Each document's words stay where they are.
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_a_key_add_up(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "c"), (None, "d"), (None, "d e")], "id long, text string")
    got = {(r.id, r.token, r.tf, r.weight) for r in retrieval.token_weights(df, "id").collect()}
    assert got == {(1, "a", 1, 0.5), (1, "b", 2, 1.0), (2, "c", 1, 1.0), (None, "d", 2, 1.0), (None, "e", 1, 0.5)}


def test_short_tokens_are_hashed_together():
    tokens = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", "größe".encode(), b"x" * 64, b"y" * 65, b"\x00", b"\x00" * 4]
    assert murmur3_all(tokens).tolist() == [murmur3(t) for t in tokens]
    assert murmur3_all([]).tolist() == []


def test_redaction_works_out_each_kind_once(spark):
    rows = [("see http://x.io/a@b.c now, me@x.org, me@y.org, +49 170 1234567 on 2024-05-06",), (None,), ("no data @ all + more ://",), ("10.0.0.1",)]
    df = spark.createDataFrame(rows, "text string")
    sanitised, types = safety.redact(F.col("text"))
    made = df.select(sanitised.alias("s"), F.array_join(types, "|").alias("t"))
    assert [(r.s, r.t) for r in made.collect()] == [("see <URL>@b.c now, <EMAIL_ADDRESS>, <EMAIL_ADDRESS>, <PHONE_NUMBER> on <DATE_TIME>", "URL|EMAIL_ADDRESS|PHONE_NUMBER|DATE_TIME"), ("", ""), ("no data @ all + more ://", ""), ("<IP_ADDRESS>", "IP_ADDRESS")]
    # One replacement for each kind, however many kinds follow.
    plan = df.select(types.alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= len(safety.PII)
