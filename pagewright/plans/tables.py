"""Queries of the joins, aggregations, folds, planning rules, scores and writers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L
from ..functions.asking import Languages, with_lexicon
from ..operators import metrics, pages, planning, receipts, spatial
from ..operators.alignment import align
from ..sources import readers, sinks
from . import fixtures as fx
from .fixtures import table, with_words

A_ID, B_ID = ("page", "ix"), ("page", "ix")


def _ab(spark, d):
    w = fx.words(spark, d)
    return fx.engine_a(w), fx.engine_b(w)


def _doc(w):
    return w.withColumn("doc_id", F.col("page")).withColumn("page", F.lit(1).cast("long"))


def j1(spark, d):
    a, b = _ab(spark, d)
    return spatial.best_partner(a.select("page", "ix", "x0", "y0", "x1", "y1"), b, A_ID).select("page", "ix", "partner", F.round("overlap", 6).alias("overlap"))


def j2(spark, d):
    a, b = _ab(spark, d)
    wide = a.withColumn("x1", F.col("x1") + 60)
    return spatial.covered_words(wide, b, A_ID).select("page", "ix", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def j4(spark, d):
    a, b = _ab(spark, d)
    return spatial.uncovered(b.select("page", "ix", "x0", "y0", "x1", "y1"), a.where("conf >= 45"), B_ID).select("page", "ix")


def j5(spark, d):
    a, b = _ab(spark, d)
    return spatial.not_printed_there(b, a.where("conf >= 45"), B_ID).select("page", "ix", "t")


def a2(spark, d):
    w = fx.engine_a(fx.words(spark, d)).where(F.length(L.letters_only(F.col("t"))) > 1).withColumn("s", L.script(L.strip_acute(F.col("t"))))
    return w.groupBy("page").agg(F.when(F.count_if(F.col("s") == "cyr") >= F.count_if(F.col("s") == "lat"), "cyr").otherwise("lat").alias("script"))


def a8(spark, d):
    w = fx.words(spark, d).withColumn("x", L.letters_only(F.when(F.col("ix") % 24 < 9, F.upper("t")).otherwise(F.col("t")))).where(F.length("x") > 1)
    up = (F.col("x") == F.upper("x")) & (F.col("x") != F.lower("x"))
    return w.groupBy("page", "line_ix").agg((2 * F.count_if(up) > F.count("*")).alias("capitals"))


def w1_context(spark, d):
    """Engine A's lines with look-alike words between Cyrillic ones settled, where the Cyrillic spellings are the commoner ones."""
    words = fx.engine_a(fx.words(spark, d)).groupBy("page", "line_ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "t"))), lambda x: x["t"]).alias("texts"))
    done = with_lexicon(words, ["page", "line_ix"], lambda row, reader: " ".join(pages.context_fold(row["texts"], reader)), T.StringType(), _languages(spark, d, 1.0))
    return done.withColumnRenamed("result", "line")


def w4_hyphens(spark, d):
    lines = F.transform(F.split(F.replace("text", F.lit("tion"), F.lit("ti-\non")), "\n"), lambda x: x)
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(sinks.joined_hyphens(lines), "\n").cast("binary")).alias("digest"), F.size(sinks.joined_hyphens(lines)).alias("n_lines"))


def w7_stretch(spark, d):
    w = _doc(fx.words(spark, d))
    p = w.select("doc_id", "page").distinct().withColumns({"w": F.lit(1000), "h": F.lit(60000), "pw": F.lit(500.0)})
    return sinks.pdf_text(w, p).select("doc_id", "line_ix", "word_ix", *(F.round(c, 4).alias(c) for c in ("font_size", "x", "base", "stretch")), "code")


def k6_script(spark, d):
    w = _doc(fx.words(spark, d))
    p = w.select("doc_id", "page").distinct().withColumns({"w": F.lit(700), "h": F.lit(3000)})
    return sinks.book_script(w, p).select("doc_id", F.md5(F.col("script").cast("binary")).alias("digest"), F.length("script").cast("long").alias("n"))


def k1_text(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_ix", "l"))
    w = c.select("doc_id", "page", "line_ix", F.posexplode(F.split("l", " ")).alias("word_ix", "t"))
    return sinks.plain_text(w).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def k7_records(spark, d):
    w = _doc(fx.words(spark, d))
    p = w.select("doc_id", "page").distinct().withColumns({"w": F.lit(1000), "h": F.lit(3000)})
    back = sinks.flat_words(sinks.page_records(w, p))
    return back.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("x1").alias("x1"), F.max("line_ix").cast("long").alias("last_line"))


def geometry(spark, d):
    """Pages of 20 orders each: lines as widths, days as heights."""
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 80).alias("doc_id"), F.row_number().over(_by("o_orderkey")).alias("page"), (F.floor("o_totalprice") % 900 + 600).cast("int").alias("w"), (F.floor("o_totalprice") % 700 + 1200).cast("int").alias("h"), F.lit(300).alias("dpi"))
    return o


def _by(col):
    from pyspark.sql import Window

    return Window.partitionBy(F.floor(F.col("o_orderkey") / 80)).orderBy(col)


_GEO = "geo AS (SELECT o_orderkey // 80 AS doc_id, row_number() OVER (PARTITION BY o_orderkey // 80 ORDER BY o_orderkey) AS page, CAST(floor(o_totalprice) AS BIGINT) % 900 + 600 AS w, CAST(floor(o_totalprice) AS BIGINT) % 700 + 1200 AS h, 300 AS dpi FROM orders)"


def _readings(spark, d):
    """The texts, dealt by document, and a poor reading of them, which is derived where the texts lie."""
    docs = spatial.dealt(table(spark, d, "documents").select("doc_id", "text"), fx.parts(spark, d), "doc_id")
    return docs.select("doc_id", F.col("text").alias("ref"), fx.misread(F.col("text")).alias("hyp"))


def word_f1(spark, d):
    return metrics.word_scores(_readings(spark, d), "doc_id")


def num_recall(spark, d):
    return metrics.number_recall(_readings(spark, d), "doc_id")


def receipt_lines(spark, d):
    """Printed rows of orders: name, quantity x price=, value; every seventh value loses a digit in the other reading."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    value = F.floor(F.col("l_extendedprice")).cast("long").cast("string")
    label = F.replace("p_name", F.lit("#"), F.lit(" "))
    line = F.concat_ws("\t", label, F.concat(F.floor("l_quantity").cast("long").cast("string"), F.lit(" x ")), value)
    hyp = F.concat_ws(" ", label, F.when(F.col("l_linenumber") % 7 == 3, F.substr(value, F.lit(2))).otherwise(value))
    rows = li.groupBy("l_orderkey").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("x")))), lambda s: s["x"]), "\n").alias(n) for c, n in ((line, "ref"), (hyp, "hyp"))))
    return rows


def row_acc(spark, d):
    return metrics.row_accuracy(receipt_lines(spark, d), "l_orderkey")


def f1_pages(spark, d):
    spec = F.element_at(F.array(*map(F.lit, ("1-3,7,9-", "", "0,5,99", "-4", "3", "2-2, 6-8"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return planning.selected_pages(table(spark, d, "supplier").select("s_suppkey", spec.alias("spec"), (F.col("s_suppkey") % 12).cast("int").alias("n"))).select("s_suppkey", "page")


_SPECS = ("bul+eng", "eng", "deu,eng", "rus", "xyz", "eng+eng")


def f2_languages(spark, d):
    spec = F.element_at(F.array(*map(F.lit, _SPECS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    lg = table(spark, d, "customer").select("c_custkey", planning.languages(spec).alias("l"), F.element_at(F.array(*map(F.lit, ("auto", "fused", "tesseract"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("asked"))
    return lg.select("c_custkey", "l.*", planning.engine(F.col("asked"), F.col("l.cyr_lex"), F.col("l.recogniser")).alias("engine"))


def j16_unfinished(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), "o_orderstatus")
    return planning.unfinished(o.select("doc_id", "page"), o.where("o_orderstatus = 'F'"))


def u5_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("state"))
    return planning.upsert(o, o.where("page % 5 = 0").withColumn("state", F.lit("new")))


def s10_tsv(spark, d):
    """Recogniser rows made of line items, read as words."""
    li = table(spark, d, "lineitem")
    text = F.concat(F.lit(" "), F.when(F.col("l_linenumber") == 5, "  ").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    raw = li.select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") % 4 == 0, "4").otherwise("5").alias("level"), (F.col("l_suppkey") % 3).cast("string").alias("block_num"), F.lit("1").alias("par_num"), (F.col("l_linenumber") % 2).cast("string").alias("line_num"), F.floor("l_quantity").cast("string").alias("left"), F.lit("10").alias("top"), F.lit("30").alias("width"), F.lit("12").alias("height"), F.lit("91.5").alias("conf"), F.when(F.col("l_linenumber") != 6, text).alias("text"), F.floor(F.col("l_extendedprice") * 100).alias("ord"))
    return readers.words_from_tsv(raw, 2.0).select("page", "line_ix", "word_ix", "t", "conf", "x0", "y0", "x1", "y1")


def s11_lines(spark, d):
    """Recognised lines made of the documents' lines, cut into words."""
    t = F.split("text", "\n")
    page = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), t.alias("texts"), F.transform(t, lambda x: F.lit(0.9)).alias("scores"), F.transform(t, lambda x, i: F.array(F.lit(10.0), i * 30.0, 10.0 + 8.0 * F.length(x), i * 30.0 + 20.0)).alias("boxes"), F.expr("cast(null as array<array<array<double>>>)").alias("polys"))
    w = readers.line_to_words(readers.recognised_lines(page))
    return w.groupBy("doc_id", "line_ix").agg(F.count("*").alias("words"), F.round(F.max("x1"), 4).alias("x1"), F.round(F.sum("x0"), 3).alias("x0"))


def s7_book(spark, d):
    dump = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), (F.col("p_size") % 4 + 1).cast("int")), lambda i: F.concat(F.lit("  INFO [10]   DjVu "), (F.col("p_partkey") + i).cast("string"), F.lit("x"), (F.col("p_size") * 100).cast("string"), F.lit(", v24, 300 dpi, gamma=2.2"))))
    return readers.book_pages(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), dump.alias("dump")))


def t41_fit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sinks.fit_box(F.lit(500.0), F.col("o_totalprice") / 100 + 50, F.lit(400.0), F.lit(600.0)).alias("b")).select("o_orderkey", *((F.round(F.col(f"b.{c}"), 6) + 0.0).alias(c) for c in ("k", "dx", "dy")))


def j15_compare(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.lit("ours").alias("system"), (F.floor("o_totalprice") % 1000 / 1000).alias("word_acc"), (F.floor("o_totalprice") % 77 / 100).alias("char_acc"))
    before = o.where("sample % 3 > 0").withColumn("word_acc", F.when(F.col("sample") % 2 == 0, F.col("word_acc") + F.lit(0.25)).otherwise(F.col("word_acc")))
    return metrics.compare_runs(o, before)


def a17_ratios(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.element_at(F.array(*map(F.lit, ("ours", "one", "two"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("system"), (F.floor("o_totalprice") % 100 / 100).alias("word_f1"))
    return metrics.error_ratios(o.groupBy("sample", "system").agg(F.max("word_f1").alias("word_f1")))


def a16_gate(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), F.element_at(F.array(F.lit("word_f1"), F.lit("char_acc")), (F.col("p_partkey") % 2 + 1).cast("int")).alias("metric"), (F.col("p_size") / 50).alias("value"))
    return metrics.below_threshold(s, s.select("sample", "metric").withColumn("least", F.lit(0.5)))


# Composed page pipelines: order-dependent, so their golden cases are in tests/.


def _languages(spark, d, gain: float = 0.0):
    """The fixtures' lexicon; the Cyrillic spellings more frequent by gain."""
    lex = fx.lexicon(spark, d)
    return Languages(lex.withColumn("zipf", F.col("zipf") + F.when(F.col("lang") == "yy", gain).otherwise(0.0)), "yy", "xx")


def t11_fuse(spark, d):
    a, b = _ab(spark, d)
    return pages.fuse_pages(_doc(a), _doc(b), _languages(spark, d))


def t10_single(spark, d):
    return pages.single_engine_pages(_doc(fx.engine_a(fx.words(spark, d))), _languages(spark, d))


def w6_rows(spark, d):
    """Receipt rows in a block of labels and a block of values on a page with a 3 % tilt, put together again."""
    li = table(spark, d, "lineitem").select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page"), (F.row_number().over(_lines()) - 1).alias("r"), F.col("l_partkey").cast("string").alias("label"), F.floor("l_extendedprice").cast("string").alias("value"))
    n = F.lit(100)
    cells = F.explode(F.array(F.struct(F.col("r").alias("line_ix"), F.lit(0).alias("word_ix"), F.col("label").alias("t"), F.lit(10.0).alias("x0")), F.struct(F.col("r").alias("line_ix"), F.lit(1).alias("word_ix"), F.lit("pcs").alias("t"), F.lit(150.0).alias("x0")), F.struct((F.col("r") + n).alias("line_ix"), F.lit(0).alias("word_ix"), F.col("value").alias("t"), F.lit(900.0).alias("x0"))))
    w = li.select("doc_id", "page", "r", cells.alias("c")).select("doc_id", "page", F.col("c.line_ix").alias("line_ix"), F.col("c.word_ix").alias("word_ix"), F.col("c.t").alias("t"), F.col("c.x0").alias("x0"), (100 + 30 * F.col("r") + 0.03 * F.col("c.x0")).alias("y0"))
    w = w.withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + 20})
    rows = pages.row_pages(w)
    return rows.groupBy("page", "line_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "t"))), lambda x: x["t"]), " ").alias("row"))


def _lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")


def a19_fixes(spark, d):
    t = table(spark, d, "benchmark").select("item_id", L.words(F.col("text"), lower=False).alias("ref"), L.words(fx.misread(F.col("text")), lower=False).alias("first"), L.words(F.translate("text", "ae", "ао"), lower=False).alias("other"), L.words(F.col("text"), lower=False).alias("ours"))
    return metrics.fix_list(t, "item_id")


def j13_alignment(spark, d):
    """Documents' words against the same words with every eleventh one misread: which stand for each other."""
    docs = spatial.dealt(table(spark, d, "documents").select("doc_id", "text"), fx.parts(spark, d), "doc_id").select("doc_id", L.words(F.col("text")).alias("ref"))
    hyp = F.transform("ref", lambda w, k: F.when(k % 11 == 5, F.concat(F.lit("q"), w)).otherwise(w))
    found = align(docs.select("doc_id", "ref", hyp.alias("hyp")), ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("ref_word") == F.col("hyp_word")).alias("equal"), F.sum(F.col("ref_ix").cast("long") * 3 + F.col("hyp_ix")).alias("places"))


_ox = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))"
_oy = "greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_tall = f"{_oy} >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)"
_cover = f"{_ox} * {_oy} * 5 > least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"
#: Lines next to each other, as an equi-join.
_near = "(SELECT *, unnest([line_ix - 1, line_ix, line_ix + 1]) AS nl FROM {})"
_bag = """a AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({ref}) AS tok FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({hyp}) AS tok FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, sum(coalesce(a.n, 0)) AS nr, sum(coalesce(b.n, 0)) AS nh, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS c FROM a FULL JOIN b USING (doc_id, tok) GROUP BY doc_id)"""

QUERIES = {
    "word_f1": word_f1, "a14_number_recall": num_recall, "a15_row_accuracy": row_acc, "j1_best_partner": j1, "j2_covered_words": j2, "j4_uncovered": j4, "j5_number_not_there": j5,
    "a2_page_script": a2, "a8_capital_lines": a8, "w1_context": w1_context, "w4_hyphens": w4_hyphens, "w7_stretch": w7_stretch, "k6_book_script": k6_script, "k1_plain_text": k1_text, "k7_records": k7_records,
    "a1_word_count": lambda spark, d: fx.words(spark, d).groupBy("page").agg(F.count("*").alias("words")),
    "a9_lines": lambda spark, d: sinks.lines(_doc(fx.words(spark, d))).select("doc_id", "line_ix", "line"),
    "a11_line_boxes": lambda spark, d: fx.words(spark, d).groupBy("page", "line_ix").agg(*(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")))),
    "f7_noise": lambda spark, d: fx.engine_a(fx.words(spark, d)).where(pages.no_noise(F.col("conf") - 40, F.col("t"))).select("page", "ix", "t"),
    "a3_geometry": lambda spark, d: planning.geometry(geometry(spark, d)).select("doc_id", "page", "median_w", "p95_h", F.round("eff_dpi", 6).alias("eff_dpi")),
    "f4_profile": lambda spark, d: planning.profile(geometry(spark, d)), "a5_sampled_height": lambda spark, d: planning.sampled_height(geometry(spark, d)),
    "f5_page_size": lambda spark, d: table(spark, d, "part").select("p_partkey", planning.page_size(F.concat(F.col("p_size").cast("string"), F.lit(".5x"), F.col("p_partkey").cast("string"), F.lit("in"))).alias("s")).select("p_partkey", "s.*"),
    "f1_pages": f1_pages, "f2_languages": f2_languages, "j16_unfinished": j16_unfinished, "u5_upsert": u5_upsert,
    "f17_empty_pages": lambda spark, d: table(spark, d, "documents").where(F.size(L.numbers(F.col("text"))) == 0).orderBy("doc_id").limit(30).select("doc_id"),
    "f16_formats": lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_except(F.split(F.lower("o_orderpriority"), "[- ]+"), F.array(*map(F.lit, (*planning.FORMATS, "1", "low")))), ",").alias("unknown")),
    "s10_tsv": s10_tsv, "s11_lines": s11_lines, "s7_book_pages": s7_book, "t41_fit_box": t41_fit, "j15_compare_runs": j15_compare, "a17_error_ratios": a17_ratios, "a16_gate": a16_gate,
    "s2_is_image": lambda spark, d: table(spark, d, "part").select("p_partkey", readers.is_image(F.concat(F.lit("/a/"), F.when(F.col("p_partkey") % 5 == 0, ".").otherwise(""), F.lit("p."), F.element_at(F.array(*map(F.lit, ("JPG", "png", "txt", "tiff", "pdf"))), (F.col("p_size") % 5 + 1).cast("int")))).alias("image")),
    "t11_fuse_pages": t11_fuse, "t10_single_engine": t10_single, "w6_printed_rows": w6_rows, "a19_fixes": a19_fixes, "j13_alignment": j13_alignment,
}

_ROWS = """li AS (SELECT l_orderkey, l_linenumber, replace(p_name, '#', ' ') AS label, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS q, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS v FROM lineitem JOIN part ON p_partkey = l_partkey)"""
ORACLE = {
    "word_f1": f"WITH {_bag.format(ref=L.sql_words('text'), hyp=L.sql_words(fx.SQL_MISREAD))}, r AS (SELECT d.doc_id, coalesce(nr, 0) AS nr, coalesce(c, 0) / greatest(1, coalesce(nr, 0)) AS rec, coalesce(c, 0) / greatest(1, coalesce(nh, 0)) AS prec FROM documents d LEFT JOIN s USING (doc_id)) SELECT doc_id, CAST(nr AS BIGINT) AS words, round(rec, 6) AS word_recall, round(prec, 6) AS word_precision, round(2 * rec * prec / greatest(1e-9, rec + prec), 6) AS word_f1 FROM r",
    "a14_number_recall": f"WITH {_bag.format(ref=L.sql_numbers('text'), hyp=L.sql_numbers(fx.SQL_MISREAD))} SELECT d.doc_id, CASE WHEN coalesce(nr, 0) > 0 THEN round(c / nr, 6) ELSE 1.0 END AS num_recall FROM documents d LEFT JOIN s USING (doc_id)",
    "a15_row_accuracy": f"WITH {_ROWS}, h AS (SELECT l_orderkey, {L.sql_words('hl')} AS words, {L.sql_numbers('hl')} AS nums FROM (SELECT l_orderkey, label || ' ' || CASE WHEN l_linenumber % 7 = 3 THEN substr(v, 2) ELSE v END AS hl FROM li)), w AS (SELECT l_orderkey, l_linenumber, label, v FROM li), o AS (SELECT w.l_orderkey, w.l_linenumber, w.v, bool_or(len(list_filter({L.sql_words('w.label')}, lambda x: NOT list_contains(h.words, x))) = 0 AND list_contains(h.nums, w.v)) AS ok FROM w JOIN h USING (l_orderkey) GROUP BY w.l_orderkey, w.l_linenumber, w.v, w.label) SELECT l_orderkey, round(count(*) FILTER (ok) / count(*), 6) AS row_acc FROM o GROUP BY l_orderkey",
    "j1_best_partner": with_words(f", c AS (SELECT a.page, a.ix, b.ix AS partner, {_ox} / greatest(1, a.x1 - a.x0, b.x1 - b.x0) AS v FROM fa a JOIN {_near.format('fb')} b ON a.page = b.page AND a.line_ix = b.nl WHERE {_tall}), k AS MATERIALIZED (SELECT page, ix, max(v) AS v, arg_min(partner, struct_pack(a := -v, b := partner)) AS partner FROM c WHERE v >= 0.4 GROUP BY page, ix) SELECT fa.page, fa.ix, k.partner, round(k.v, 6) AS overlap FROM fa LEFT JOIN k USING (page, ix)"),
    "j2_covered_words": with_words(f", w AS (SELECT * REPLACE (x1 + 60 AS x1) FROM fa) SELECT a.page, a.ix, string_agg(CAST(b.ix AS VARCHAR), ',' ORDER BY b.x0, b.ix) AS parts FROM w a JOIN {_near.format('fb')} b ON a.page = b.page AND a.line_ix = b.nl WHERE {_tall} AND {_ox} >= 0.6 * greatest(1, b.x1 - b.x0) GROUP BY a.page, a.ix"),
    "j4_uncovered": with_words(f" SELECT page, ix FROM fb a WHERE NOT EXISTS (SELECT 1 FROM {_near.format('fa')} b WHERE a.page = b.page AND a.line_ix = b.nl AND conf >= 45 AND {_cover})"),
    "j5_number_not_there": with_words(f" SELECT page, ix, t FROM fb a WHERE NOT EXISTS (SELECT 1 FROM {_near.format('fa')} b WHERE a.page = b.page AND a.line_ix = b.nl AND conf >= 45 AND {_cover} AND trim(a.t, '(),;:') = trim(b.t, '(),;:'))"),
    "a2_page_script": with_words(rf", s AS (SELECT page, {L.sql_script(L.sql_without('t', L.ACUTE))} AS s FROM fa WHERE length(regexp_replace(t, '[^\p{{L}}\p{{Nl}}\p{{No}}]', '', 'g')) > 1) SELECT page, CASE WHEN count(*) FILTER (s = 'cyr') >= count(*) FILTER (s = 'lat') THEN 'cyr' ELSE 'lat' END AS script FROM s GROUP BY page"),
    "a8_capital_lines": with_words(r", x AS (SELECT page, line_ix, regexp_replace(CASE WHEN ix % 24 < 9 THEN upper(replace(t, 'ß', 'ss')) ELSE t END, '[^\p{L}\p{Nl}\p{No}]', '', 'g') AS x FROM fw) SELECT page, line_ix, 2 * count(*) FILTER (x = upper(x) AND x <> lower(x)) > count(*) AS capitals FROM x WHERE length(x) > 1 GROUP BY page, line_ix"),
    "w4_hyphens": r"""WITH RECURSIVE p AS (SELECT doc_id, string_split(replace(text, 'tion', 'ti-' || chr(10) || 'on'), chr(10)) AS l FROM documents),
f(doc_id, l, i, done, held) AS (SELECT doc_id, l, 1, CAST([] AS VARCHAR[]), l[1] FROM p UNION ALL
 SELECT doc_id, l, i + 1, CASE WHEN j AND rest = '' THEN done ELSE list_append(done, CASE WHEN j THEN left(held, length(held) - 1) || head ELSE held END) END,
  CASE WHEN j AND rest = '' THEN left(held, length(held) - 1) || head WHEN j THEN rest ELSE x END
 FROM (SELECT *, regexp_matches(held, '[\p{L}\p{N}_]-$') AND left(x, 1) = lower(left(x, 1)) AND left(x, 1) <> upper(left(x, 1)) AS j, CASE WHEN contains(x, ' ') THEN split_part(x, ' ', 1) ELSE x END AS head, CASE WHEN contains(x, ' ') THEN substr(x, strpos(x, ' ') + 1) ELSE '' END AS rest FROM (SELECT *, l[i + 1] AS x FROM f WHERE i < len(l))))
SELECT doc_id, md5(array_to_string(list_append(done, held), chr(10))) AS digest, CAST(len(done) + 1 AS INTEGER) AS n_lines FROM f WHERE i = len(l)""",
    "w7_stretch": with_words(" , g AS (SELECT page AS doc_id, line_ix, word_ix, t, min(y0) OVER l * 0.5 AS top, max(y1) OVER l * 0.5 AS low, lead(x0) OVER (l ORDER BY word_ix) * 0.5 AS nx, x0 * 0.5 AS px, (x1 - x0) * 0.5 AS own FROM fw WINDOW l AS (PARTITION BY page, line_ix)), h AS (SELECT *, greatest(1.0, low - top) AS fs, CASE WHEN nx IS NULL THEN t ELSE t || ' ' END AS tx, CASE WHEN nx IS NULL THEN own ELSE greatest(own, nx - px) END AS target FROM g) SELECT doc_id, line_ix, word_ix, round(fs, 4) AS font_size, round(px, 4) AS x, round(30000 - low + (low - top) * 0.15, 4) AS base, round(100 * greatest(target, 0.5) / (length(tx) * 0.5 * fs), 4) AS stretch, array_to_string(list_transform(string_split(tx, ''), lambda c: printf('%04x', unicode(c))), '') AS code FROM h"),
    "k6_book_script": with_words(r""", w AS (SELECT page, line_ix, word_ix, t, CAST(greatest(0, least(x0, 700)) AS INTEGER) AS a, CAST(3000 - greatest(0, least(y1, 3000)) AS INTEGER) AS b, CAST(greatest(0, least(x1, 700)) AS INTEGER) AS c, CAST(3000 - greatest(0, least(y0, 3000)) AS INTEGER) AS d FROM fw),
l AS (SELECT page, line_ix, ' (line ' || min(a) || ' ' || min(b) || ' ' || max(c) || ' ' || max(d) || ' ' || string_agg('(word ' || a || ' ' || b || ' ' || c || ' ' || d || ' "' || replace(replace(t, '\', '\\'), '"', '\"') || '")', ' ' ORDER BY word_ix) || ')' AS s FROM w GROUP BY page, line_ix),
s AS (SELECT page AS doc_id, 'select 1' || chr(10) || 'set-txt' || chr(10) || '(page 0 0 700 3000' || chr(10) || string_agg(s, chr(10) ORDER BY line_ix) || ')' || chr(10) || '.' || chr(10) AS script FROM l GROUP BY page)
SELECT doc_id, md5(script) AS digest, length(script) AS n FROM s"""),
    "k1_plain_text": "WITH p AS (SELECT conv_id, turn, text || chr(10) AS t FROM conversations) SELECT conv_id AS doc_id, md5(string_agg(t, chr(12) ORDER BY turn)) AS digest FROM p GROUP BY conv_id",
    "k7_records": with_words(" SELECT page AS doc_id, count(*) AS words, sum(x1) AS x1, CAST(max(line_ix) AS BIGINT) AS last_line FROM fw GROUP BY page"),
    "a1_word_count": with_words(" SELECT page, count(*) AS words FROM fw GROUP BY page"),
    "a9_lines": with_words(" SELECT page AS doc_id, line_ix, string_agg(t, ' ' ORDER BY word_ix) AS line FROM fw GROUP BY page, line_ix"),
    "a11_line_boxes": with_words(" SELECT page, line_ix, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fw GROUP BY page, line_ix"),
    "f7_noise": with_words(" SELECT page, ix, t FROM fa WHERE conf >= 60 OR regexp_matches(t, '[Ѐ-ӿA-Za-z]')"),
    "a3_geometry": f"WITH {_GEO}, g AS (SELECT doc_id, median(CAST(w AS DOUBLE)) AS median_w, round(quantile_cont(CAST(h AS DOUBLE), 0.95), 2) AS p95_h FROM geo GROUP BY doc_id) SELECT doc_id, page, median_w, p95_h, round(CASE WHEN w > 1.3 * median_w THEN dpi * w / median_w ELSE dpi END, 6) AS eff_dpi FROM geo JOIN g USING (doc_id)",
    "f4_profile": f"WITH {_GEO} SELECT doc_id, CASE WHEN median(h / w) FILTER (page <= 5) >= 1.7 THEN 'receipt' ELSE 'book' END AS profile FROM geo GROUP BY doc_id",
    "a5_sampled_height": f"WITH {_GEO}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM geo) SELECT doc_id, round_even(median(h / w) * 5.5 * 4, 0) / 4 AS height FROM r WHERE r % greatest(1, n // 40) = 0 GROUP BY doc_id",
    "f5_page_size": "SELECT p_partkey, p_size + 0.5::DOUBLE AS width, p_partkey::DOUBLE AS height FROM part",
    "f1_pages": "WITH s AS (SELECT s_suppkey, s_suppkey % 12 AS n, s_suppkey % 6 AS k, unnest(range(1, s_suppkey % 12 + 1)) AS page FROM supplier) SELECT s_suppkey, CAST(page AS INTEGER) AS page FROM s WHERE CASE k WHEN 0 THEN page IN (1, 2, 3, 7) OR page >= 9 WHEN 1 THEN true WHEN 2 THEN page = 5 WHEN 3 THEN page <= 4 WHEN 4 THEN page = 3 ELSE page = 2 OR page BETWEEN 6 AND 8 END",
    "f2_languages": f"""WITH s AS (SELECT c_custkey, c_custkey % 6 AS k, c_custkey % 3 AS m FROM customer), l AS (SELECT c_custkey, m, ['bul+eng', 'eng', 'deu+eng', 'rus', 'xyz', 'eng+eng'][k + 1] AS tess, ['bg', NULL, NULL, 'ru', NULL, NULL][k + 1] AS cyr_lex, ['en', 'en', 'de', NULL, NULL, 'en'][k + 1] AS lat_lex,
['{planning.MODEL_CYR}', '{planning.MODEL_EN}', '{planning.MODEL_LAT}', '{planning.MODEL_CYR}', NULL, '{planning.MODEL_EN}'][k + 1] AS recogniser FROM s) SELECT c_custkey, tess, cyr_lex, lat_lex, recogniser, CASE WHEN m < 2 AND cyr_lex IS NOT NULL AND recogniser IS NOT NULL THEN 'fused' ELSE 'tesseract' END AS engine FROM l""",
    "j16_unfinished": "SELECT o_custkey AS doc_id, o_orderkey AS page FROM orders WHERE o_orderstatus <> 'F'",
    "u5_upsert": "SELECT o_custkey AS doc_id, o_orderkey AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS state FROM orders",
    "f17_empty_pages": r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '\p{Nd}') ORDER BY doc_id LIMIT 30",
    "f16_formats": "SELECT o_orderkey, array_to_string(list_filter(regexp_split_to_array(lower(o_orderpriority), '[- ]+'), lambda x: x NOT IN ('pdf', 'djvu', 'txt', '1', 'low')), ',') AS unknown FROM orders",
    "s10_tsv": "WITH r AS (SELECT l_orderkey AS page, l_suppkey % 3 AS b, l_linenumber % 2 AS l, CAST(floor(l_extendedprice * 100) AS BIGINT) AS ord, l_returnflag || l_linestatus AS t, CASE WHEN l_linenumber = 5 THEN l_linestatus END AS five, CAST(floor(l_quantity) AS INTEGER) AS x FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_linenumber <> 6) SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY b, l) - 1 AS INTEGER) AS line_ix, CAST(row_number() OVER (PARTITION BY page, b, l ORDER BY ord) - 1 AS INTEGER) AS word_ix, coalesce(five, t) AS t, 91.5::DOUBLE AS conf, (x * 2)::DOUBLE AS x0, 20::DOUBLE AS y0, ((x + 30) * 2)::DOUBLE AS x1, 44::DOUBLE AS y1 FROM r",
    "s11_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
c AS (SELECT doc_id, k, length(raw) AS wide, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM l),
r AS (SELECT doc_id, k, wide, length(t) AS n, unnest(regexp_extract_all(t, '\s+|\S+')) AS p, unnest(range(len(regexp_extract_all(t, '\s+|\S+')))) AS i FROM c),
o AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM r)
SELECT doc_id, CAST(k AS INTEGER) AS line_ix, count(*) AS words, round(max(10 + 8.0::DOUBLE * wide * ((a + length(p))::DOUBLE / n)), 4) AS x1, round(sum(10 + 8.0::DOUBLE * wide * (a::DOUBLE / n)), 3) AS x0 FROM o WHERE regexp_matches(p, '\S') GROUP BY doc_id, k""",
    "s7_book_pages": "SELECT p_partkey AS doc_id, CAST(i AS INTEGER) AS page, CAST(p_partkey + i AS INTEGER) AS w, p_size * 100 AS h, 300 AS dpi FROM (SELECT *, unnest(range(1, p_size % 4 + 2)) AS i FROM part)",
    "t41_fit_box": "WITH s AS (SELECT o_orderkey, o_totalprice / 100 + 50 AS ph, least(400.0::DOUBLE / 500, 600 / (o_totalprice / 100 + 50)) AS k FROM orders) SELECT o_orderkey, round(k, 6) AS k, round((400 - 500 * k) / 2, 6) + 0.0::DOUBLE AS dx, round((600 - ph * k) / 2, 6) + 0.0::DOUBLE AS dy FROM s",
    "j15_compare_runs": "SELECT o_orderkey AS sample, 'ours' AS system, CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 2 = 0 THEN '-0.2500 0.0000' ELSE 'same' END AS delta FROM orders",
    "a17_error_ratios": "WITH s AS (SELECT o_custkey AS sample, ['ours', 'one', 'two'][o_orderkey % 3 + 1] AS system, max(CAST(floor(o_totalprice) AS BIGINT) % 100 / 100) AS f FROM orders GROUP BY ALL) SELECT a.system, count(*) AS samples, round(sum(1 - a.f) / greatest(1e-6, sum(1 - b.f)), 6) AS ratio FROM s a JOIN s b ON a.sample = b.sample AND b.system = 'ours' WHERE a.system <> 'ours' GROUP BY a.system",
    "a16_gate": "SELECT p_partkey AS sample, ['word_f1', 'char_acc'][p_partkey % 2 + 1] AS metric, p_size / 50 AS value, 0.5::DOUBLE AS least FROM part WHERE p_size / 50 < 0.5",
    "s2_is_image": "SELECT p_partkey, p_partkey % 5 <> 0 AND p_size % 5 IN (0, 1, 3) AS image FROM part",
    "j13_alignment": f"WITH w AS (SELECT doc_id, {L.sql_words('text')} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM w) SELECT doc_id, count(*) AS pairs, count(*) FILTER (k % 11 <> 5) AS equal, CAST(sum(4 * k) AS BIGINT) AS places FROM p GROUP BY doc_id",
    "w6_printed_rows": None,
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
