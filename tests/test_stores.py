import re
import uuid

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pagewright.operators import spatial
from pagewright.sources import stores

SCHEMA = "date string, commit string, version string, sample string, system string, words long, word_acc double, char_acc double"


def test_runs_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = [("2024-01-01", "a", "1", "s/1 %", "ours", 10, 0.98765, 0.5), ("2024-01-01", "a", "1", None, "ours", 3, None, 0.5), ("2024-01-02", "a", "1", "", "x", 1, 1.0, 1.0)]
    for _ in range(2):
        stores.put_runs(spark.createDataFrame([*first, first[0]], SCHEMA).withColumn("row", F.lit("x")), path)
    got = {(r.date, r.sample, r.system): (r.commit, r.words, r.word_acc and float(r.word_acc)) for r in stores.runs(spark, path).collect()}
    assert stores.runs(spark, path).count() == 3
    assert got == {("2024-01-01", "s/1 %", "ours"): ("a", 10, 0.9877), ("2024-01-01", None, "ours"): ("a", 3, None), ("2024-01-02", None, "x"): ("a", 1, 1.0)}

    @F.udf("string")
    def fails(system):
        if system == "x":
            raise ValueError("lost")
        return "b"

    again = spark.createDataFrame(first, SCHEMA)
    with pytest.raises(PythonException):
        stores.put_runs(again.withColumn("commit", fails("system")), path)
    assert {r.commit for r in stores.runs(spark, path).collect()} == {"a"}
    stores.put_runs(again.limit(1).withColumn("commit", F.lit("b")), path)
    assert sorted(r.commit for r in stores.runs(spark, path).collect()) == ["a", "a", "b"]
    stores.put_runs(again.limit(0), path)
    assert stores.runs(spark, path).count() == 3


def test_stored_words_join_without_an_exchange(spark, tmp_path):
    """Every join by place gives the same over stored tables, and the join reads them as they lie."""
    at = F.col("id")
    x, y = (at * 37 % 400).cast("double"), (at * 13 % 900).cast("double")
    a = spark.range(400).select((at % 5).alias("page"), at.cast("int").alias("ix"), (at % 9).cast("string").alias("t"), x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + at % 90).alias("y1"))
    b = a.withColumns({"ix": F.col("ix") + 1000, "x0": F.col("x0") + 4, "y1": F.col("y1") + 1})
    sa, sb = (stores.store_words(df, f"t_{uuid.uuid4().hex}", str(tmp_path / n), buckets=3) for df, n in ((a, "a"), (b, "b")))
    assert spatial.once(sa).count() == 400 < sa.count() and sorted(spatial.once(sa).columns) == sorted(a.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    key = ("page", "ix")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for f in (lambda p, q: spatial.best_partner(p, q, key), lambda p, q: spatial.covered_words(p, q, key), lambda p, q: spatial.uncovered(q, p, key), lambda p, q: spatial.not_printed_there(q, p, key), lambda p, q: spatial.nearby(p, q), lambda p, q: spatial.best_number(p, q, key)):
            got = f(sa, sb)
            assert rows(got) == rows(f(a, b)) != []
        plan = spatial.pairs(sa, sb)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"\bExchange\b", plan)
        assert re.search(r"\bExchange\b", spatial.pairs(a, b)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_of_dealt_pages_move_no_words(spark, tmp_path):
    """Words of texts are dealt once, as texts: joins by place, lines and stored words need no further exchange."""
    from pagewright.plans import fixtures as fx
    from pagewright.plans.pagequeries import _stored
    from pagewright.sources import sinks

    texts = [(1, "one two  three\nfour " * 9), (2, ""), (3, None), (4, "a" * 30)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    w = fx.words(spark, str(tmp_path))
    got = [(r.page, r.line_ix, r.word_ix, r.ix, r.t, r.x0, r.y0, r.x1, r.y1) for r in w.orderBy("page", "ix").collect()]
    want = []
    for page, text in texts:
        at = 0
        for ix, t in enumerate((text or "").replace("\n", " ").split(" ")):
            at = at if ix % 12 else 0
            if t:
                want.append((page, ix // 12, ix % 12, ix, t, at * 10.0, ix // 12 * 30.0, (at + len(t)) * 10.0, ix // 12 * 30.0 + 20))
            at += len(t) + 1
    assert got == want
    moves = lambda df: len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = fx.engine_a(w), fx.engine_b(w)
        for f in (spatial.best_partner, spatial.covered_words, spatial.uncovered, spatial.not_printed_there):
            assert 0 < moves(f(a, b, ("page", "ix"))) <= 3  # the texts, once for each reading of the words
        assert moves(sinks.lines(w.withColumnRenamed("page", "doc_id").withColumn("page", F.lit(1)))) == 1
        assert moves(spatial.covered_words(*_stored(spark, str(tmp_path)), ("page", "ix"))) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
