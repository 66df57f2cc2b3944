"""Rows picked by keys; user columns of any name keep their values."""

from pyspark.sql import functions as F

from textloom import rows
from textloom.storage import ARROW_BYTES, bound_batches


def _table(spark):
    data = [(i % 40 if i % 7 else None, f"t{i % 11}", i, -i, 2 * i, 3 * i) for i in range(400)]
    return spark.createDataFrame(data, "id long, text string, _key0 long, _KEY1 int, `_key2.x` long, a.b long".replace("a.b", "`a.b`"))


def test_rows_go_by_keys_with_and_without_a_filter(spark):
    docs = _table(spark)
    gone = spark.createDataFrame([(3, "t3"), (None, "t0"), (5, "nothing"), (None, None), (3, "t3")], "id long, text string")
    want = sorted((tuple(r) for r in docs.collect() if (r.id, r.text) not in {(3, "t3"), (None, "t0")}), key=str)
    assert 0 < len(want) < 400
    for most in (rows.BROADCAST_ROWS, 0):
        left = rows.without_rows(docs, [F.col("id"), F.col("text")], gone, most)
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.collect()), key=str) == want
    assert rows.without_rows(docs, [F.col("id"), F.col("text")], gone.limit(0), 0).count() == 400
    assert rows.without_rows(docs.limit(0), [F.col("id"), F.col("text")], gone, 0).count() == 0


def test_texts_that_the_filter_rules_out_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(rows, "FILTER_WORDS", 1 << 12)
    docs = spark.range(20_000).selectExpr("id", "repeat('x', 50) text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = rows.without_rows(docs, [F.col("id")], spark.range(0, 20_000, 10), 0)
        assert len(left.collect()) == 18_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = sum(_shuffle_records(left._jdf.queryExecution().executedPlan()))
    # All keys of the rows that go, these rows, and the few that the filter takes for them.
    assert 4_000 <= moved < 6_000


def _shuffle_records(plan):
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_values_join_under_fresh_names(spark):
    docs = _table(spark)
    found = spark.createDataFrame([(3, "t3", "x"), (None, "t0", "y")], "id long, text string, value string")
    for most in (rows.BROADCAST_ROWS, 0):
        joined, added = rows.with_value(docs, [F.col("id"), F.col("text")], found, most)
        got = {(*r[:4],): r[added[-1]] for r in joined.collect()}
        assert all(v == {(3, "t3"): "x", (None, "t0"): "y"}.get(k[:2]) for k, v in got.items()) and len(got) == 400
        assert joined.drop(*added).columns == docs.columns


def test_batches_are_bounded_from_any_setting(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    for said, want in (("64m", str(ARROW_BYTES)), ("1k", "1k"), (str(1 << 30), str(ARROW_BYTES)), ("2097152b", "2097152b")):
        spark.conf.set(name, said)
        bound_batches(spark)
        assert spark.conf.get(name) == want
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)
