"""Findings of round 3 on scores and lines: long lines, and tokens that stay where their text lies."""

import re
import time

from pyspark.sql import functions as F

from pagewright.operators import metrics
from pagewright.plans import tables
from pagewright.sources import readers

LINES = ["", "  a  ", "один два", "a\tb\x0bc\rd", "ж ж x", "  y", "😀 b 😀😀", "one", " "]


def test_words_of_lines_are_placed_by_characters(spark):
    df = spark.createDataFrame([*enumerate(LINES), (99, None)], "k int, text string").repartition(2)
    got = {r.k: [(w.t, w.a, w.z) for w in r.w] for r in df.select("k", readers.placed_words(F.col("text")).alias("w")).collect()}
    assert got == {k: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", x or "")] for k, x in [*enumerate(LINES), (99, None)]}


def test_a_line_of_many_words_takes_linear_time(spark):
    """the words of a line were appended one by one to a copied array."""
    line = spark.range(1).select("id", F.lit(1).alias("page"), F.lit(0).alias("line_ix"), F.expr("repeat('abc ', 300000)").alias("text"), F.lit(0.9).alias("score"), F.expr("array(0D, 0D, 1200000D, 20D)").alias("box"), F.expr("cast(null as array<array<double>>)").alias("poly"))
    began = time.time()
    found = readers.line_to_words(line.withColumnRenamed("id", "doc_id")).agg(F.count("*"), F.max("x1")).first()
    assert found[0] == 300_000 and time.time() - began < 60


def test_tokens_of_dealt_texts_do_not_move(spark, tmp_path):
    """word_f1 and a14 dealt every token of both readings by text and token, and again by text."""
    spark.createDataFrame([(k, "the 15 of the " + "x" * k) for k in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (tables.word_f1, tables.num_recall):
        out = query(spark, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and out.count() == 50


def test_words_of_a_line_are_cut_once(spark):
    """the words of both readings were cut anew for each use of them."""
    lines = spark.createDataFrame([(1, "a b", "a c")], "k int, ref string, hyp string")
    both = lines.select("k", metrics.joined_words(F.col("ref")).alias("a"), metrics.joined_words(F.col("hyp")).alias("b"))
    assert both.select(metrics.accuracy(F.col("a"), F.col("b"))).first()[0] == lines.select(metrics.character_accuracy(F.col("ref"), F.col("hyp"))).first()[0]


def test_rows_are_compared_where_they_lie(spark):
    """the other reading's lines were copied for each row with a value."""
    till = spark.createDataFrame([(1, "tea\t1 x\t12\nno value\nrye\t7", "tea 12\nrye 8"), (2, None, "x"), (3, "tea\t3", None)], "k int, ref string, hyp string")
    scored = metrics.row_accuracy(till, "k")
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {x.k: x.row_acc for x in scored.collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
