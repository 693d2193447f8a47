"""Queries of whole page routes, receipts, reports and run rules, over tables whose right results SQL can tell."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import locale
from ..operators import pages, planning, receipts, reports, spatial
from ..sources import sinks, stores
from ..streaming import documents
from . import fixtures as fx
from .fixtures import table, with_words
from .scalars import ORACLE as SCALARS
from .scalars import _terms
from .tables import ORACLE as TABLES


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _items(spark, d):
    """Line items numbered within their order: line."""
    return table(spark, d, "lineitem").withColumn("line", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1).cast("int"))


def _till(spark, d):
    """Receipt rows: a misread label, a price cut in two at its point, and the VAT letter, on pages by order."""
    li = _items(spark, d)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = F.array(F.lit("CYMA"), F.concat(F.floor(cents / 100).cast("string"), F.lit(".")), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("6"))
    w = li.select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("line").alias("line_ix"), F.posexplode(parts).alias("word_ix", "t"))
    x = 100.0 * F.col("word_ix")
    return w.withColumns({"x0": x, "y0": 30.0 * F.col("line_ix"), "x1": x + 90, "y1": 30.0 * F.col("line_ix") + 20})


def _joined(words):
    by = words.groupBy("page", "line_ix").agg(F.array_sort(F.collect_list(F.struct("word_ix", "t"))).alias("w"))
    return by.select("page", "line_ix", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("row"))


def _lines(spark, d):
    """Recognised lines of the second engine, a line for each line item."""
    li = _items(spark, d)
    text = F.concat(F.lit(" item "), F.col("l_partkey").cast("string"), F.lit(" qty "), F.floor("l_quantity").cast("string"))
    y = 30.0 * F.col("line")
    none = F.lit(None).cast("array<array<double>>")
    return li.select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("line").alias("line_ix"), text.alias("text"), F.lit(0.9).alias("score"), F.array(F.lit(0.0), y, F.lit(400.0), y + 20).alias("box"), none.alias("poly"))


def _noisy_words(spark, d):
    """Words of the first engine: a part number and a mark whose confidence follows the line."""
    li = _items(spark, d)
    parts = F.array(F.struct(F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("t"), F.lit(5.0).alias("conf")), F.struct(F.lit("||").alias("t"), ((F.col("line") + 1) * 8.0).alias("conf")))
    w = li.select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("line").alias("line_ix"), F.posexplode(parts).alias("word_ix", "w"))
    x = 200.0 * F.col("word_ix")
    return w.select("doc_id", "page", "line_ix", "word_ix", "w.t", "w.conf", x.alias("x0"), (30.0 * F.col("line_ix")).alias("y0"), (x + 150).alias("x1"), (30.0 * F.col("line_ix") + 20).alias("y1"))


def j3_nearby(spark, d):
    w = fx.words(spark, d)
    a, b = (e(w).where(L.is_number(F.col("t"))) for e in (fx.engine_a, fx.engine_b))
    return spatial.nearby(a, b).select(F.col("l_page").alias("page"), F.col("l_ix").alias("ix"), F.col("r_ix").alias("other"))


def j3_best_number(spark, d):
    """Engine A's numbers with the word of engine B, around them, that holds the most similar number."""
    w = fx.words(spark, d)
    return spatial.best_number(fx.engine_a(w), fx.engine_b(w), ("page", "ix")).select("page", "ix", "partner", F.round("likeness", 6).alias("likeness"))


def _fixes(spark, d):
    p = table(spark, d, "part")
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("сок"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.lit("река")).otherwise(F.upper(F.substring("p_name", 1, 9))).alias("ref"), F.translate(F.substring("p_name", 1, 9), "aeo", "аео").alias("first"), F.lower(other).alias("other"))


def t26_marked(spark, d):
    f = _fixes(spark, d)
    return f.select("p_partkey", reports.marked(F.col("first"), F.col("ref")).alias("first"), reports.marked(F.col("other"), F.col("ref")).alias("other"))


_LANGS = ("en", "de", "fr", "bg", "xx")


def _by_language(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.floor("o_totalprice") % 1000 / 1000).alias("x"), (F.floor("o_totalprice") % 100 / 10).alias("y"), F.element_at(F.array(*map(F.lit, _LANGS)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("lang"))


def st_documents(spark, d):
    """Conversations as documents, turns as their pages: gathered from a stream of the table's files, in any order. One row for each
    conversation that has all its turns, from 0 on; of equal turns the greatest text counts."""
    page = ["conv_id as doc_id", "turn + 1 as page", r"concat(coalesce(text, ''), '\n') as text"]
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg((F.max("turn") + 1).alias("n_pages"))
    source = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")  # a pattern: one file or a folder of them
    out = documents.gathered(source.selectExpr(*page).join(n, "doc_id"))
    whole = documents.landed(out).where("state = 'done'")
    texts = sinks.joined_pages(whole).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return whole.groupBy("doc_id").agg(F.count("*").alias("pages")).join(texts, "doc_id")


def _stored(spark, d):
    """Both engines' words as bucketed tables."""
    n = fx.parts(spark, d)
    w = fx.words(spark, d, n)
    keep = lambda df: stores.store_words(df, f"words_{uuid.uuid4().hex}", stores.temporary(spark, "words"), n, lie=True)
    return keep(fx.engine_a(w).withColumn("x1", F.col("x1") + 60)), keep(fx.engine_b(w))


def j2_stored(spark, d):
    a, b = _stored(spark, d)
    return spatial.covered_words(a, b, ("page", "ix")).select("page", "ix", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def _scores(spark, d):
    """Documents as runs: the source is the sample, the language the system, and the date follows the source's length."""
    by = table(spark, d, "documents").groupBy(F.col("source").alias("sample"), F.col("lang").alias("system"))
    acc = lambda k: (F.floor(F.count_if(F.col("doc_id") % k == 0) * 10000 / F.count("*")) / 10000).cast("decimal(10,4)")
    date = F.format_string("2024-01-%02d", F.coalesce(F.length("sample"), F.lit(1)).cast("int"))
    return by.agg(F.count("*").alias("words"), acc(3).alias("word_acc"), acc(7).alias("char_acc")).select("*", date.alias("date"), F.lit("c1").alias("commit"), F.lit("1").alias("version"))


def k10_runs(spark, d):
    """All runs stored, then all again, and at last those of languages from f on by a later version: one row a run is left."""
    path, s = stores.temporary(spark, "runs"), _scores(spark, d)
    for run in (s.withColumn("words", F.lit(0)), s, s.where("system >= 'f'").withColumns({"version": F.lit("2"), "words": F.col("words") + 1})):
        stores.put_runs(run, path)
    return stores.runs(spark, path)


QUERIES = {
    "j2_stored_words": j2_stored, "k10_runs": k10_runs,
    "st_documents": st_documents, "j3_nearby": j3_nearby, "j3_best_number": j3_best_number,
    "t19_fix_word": lambda spark, d: receipts.fixed_words(_terms(spark, d).select("p_partkey", "core"), "core"),
    "w5_receipt_rows": lambda spark, d: _joined(pages.row_pages(_till(spark, d), receipt=True)),
    "t12_recognised_pages": lambda spark, d: _joined(pages.recognised_pages(_lines(spark, d), receipt=False)),
    "t16_build_pages": lambda spark, d: _joined(pages.build_pages(_noisy_words(spark, d), None)),
    "t26_marked": t26_marked,
    "a18_examples": lambda spark, d: reports.examples(_fixes(spark, d), "p_partkey"),
    "k11_report_table": lambda spark, d: reports.markdown_table(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_name", "n_regionkey"], "n_nationkey"),
    "k12_names": lambda spark, d: table(spark, d, "part").select("p_partkey", reports.output_name(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("")), F.col("p_type")).alias("name"), reports.producer("engine", F.lit("fused"), F.lit("bul+eng")).alias("producer")),
    "t35_figures": lambda spark, d: _by_language(spark, d).select("o_orderkey", reports.percent(F.col("x"), F.col("lang")).alias("share"), reports.times(F.col("y"), F.col("lang")).alias("factor")),
    "t32_language": lambda spark, d: _by_language(spark, d).select("o_orderkey", locale.chosen(F.col("lang")).alias("lang")),
    "o9_name_key": lambda spark, d: fx.tokens(spark, d).select("t", L.name_key(F.col("t")).alias("name_key")),
    "f18_threads": lambda spark, d: table(spark, d, "supplier").select("s_suppkey", planning.threads((F.col("s_suppkey") % 14).cast("int"), F.when(F.col("s_suppkey") % 3 > 0, F.lit(8))).alias("t")).select("s_suppkey", "t.*"),
    "t40_detector": lambda spark, d: table(spark, d, "supplier").select("s_suppkey", planning.detector(F.when(F.col("s_suppkey") % 2 == 0, "receipt").otherwise("book"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(0.5)), F.lit(None).cast("double")).alias("t")).select("s_suppkey", "t.*"),
    "j17_required": lambda spark, d: planning.required(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page")), table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"))),
}

_FIX = """f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'река' ELSE upper(substr(p_name, 1, 9)) END AS ref, translate(substr(p_name, 1, 9), 'aeo', 'аео') AS first, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'сок' END) AS other FROM part)"""


def _mark(c: str) -> str:
    cyr, lat = f"regexp_matches(ref, '{L.CYR}')", f"regexp_matches(ref, '{L.LAT}')"
    return rf"CASE WHEN {c} IS NULL THEN '–' WHEN lower({c}) = lower(ref) THEN {c} || ' ✓' WHEN {cyr} AND NOT {lat} THEN regexp_replace({c}, '({L.LAT}+)', '**\1**', 'g') WHEN {lat} AND NOT {cyr} THEN regexp_replace({c}, '({L.CYR}+)', '**\1**', 'g') ELSE {c} END"


_LANG = "['en', 'de', 'fr', 'bg', 'xx'][o_orderkey % 5 + 1]"
_X = "CAST(floor(o_totalprice) AS BIGINT) % 1000"
_shown = lambda v: f"CASE WHEN {_LANG} = 'en' THEN {v} ELSE replace({v}, '.', ',') END"
ORACLE = {
    "j2_stored_words": TABLES["j2_covered_words"],
    "k10_runs": """WITH s AS (SELECT source AS sample, lang AS system, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS a, count(*) FILTER (doc_id % 7 = 0) AS b FROM documents GROUP BY ALL)
SELECT 'c1' AS commit, CASE WHEN system >= 'f' THEN '2' ELSE '1' END AS version, n + CASE WHEN system >= 'f' THEN 1 ELSE 0 END AS words, CAST(a * 10000 // n / 10000 AS DECIMAL(10, 4)) AS word_acc,
 CAST(b * 10000 // n / 10000 AS DECIMAL(10, 4)) AS char_acc, '2024-01-' || lpad(CAST(coalesce(length(sample), 1) AS VARCHAR), 2, '0') AS date, sample, system FROM s""",
    "st_documents": """WITH t AS (SELECT conv_id AS doc_id, turn, max(coalesce(text, '') || chr(10)) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0 GROUP BY ALL)
SELECT doc_id, count(*) AS pages, md5(string_agg(t, chr(12) ORDER BY turn)) AS digest FROM t GROUP BY doc_id HAVING count(*) = max(turn) + 1""",
    "j3_nearby": with_words(r""", a AS (SELECT * FROM fa WHERE NOT regexp_matches(t, '[Ѐ-ӿA-Za-z]') AND regexp_matches(t, '\p{Nd}')), b AS (SELECT *, unnest([line_ix - 1, line_ix, line_ix + 1]) AS nl FROM fb WHERE NOT regexp_matches(t, '[Ѐ-ӿA-Za-z]') AND regexp_matches(t, '\p{Nd}'))
 SELECT a.page, a.ix, b.ix AS other FROM a JOIN b ON a.page = b.page AND a.line_ix = b.nl WHERE greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.3 * least(a.y1 - a.y0, b.y1 - b.y0) AND abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= greatest(a.x1 - a.x0, b.x1 - b.x0)"""),
    "t19_fix_word": f"SELECT p_partkey, core, coalesce(term, core) AS fixed FROM ({SCALARS['j8_receipt_terms']})",
    "w5_receipt_rows": "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS line_ix, 'СУМА ' || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' Б' AS row FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)",
    "t12_recognised_pages": "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS line_ix, 'item ' || l_partkey || ' qty ' || CAST(floor(l_quantity) AS BIGINT) AS row FROM lineitem",
    "t16_build_pages": "SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS line_ix, 'part' || l_partkey || CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) * 8 >= 20 THEN ' ||' ELSE '' END AS row FROM lineitem",
    "t26_marked": f"WITH {_FIX} SELECT p_partkey, {_mark('first')} AS first, {_mark('other')} AS other FROM f",
    "a18_examples": f"""WITH {_FIX}, r AS (SELECT *, coalesce(lower(other) = lower(ref), false) AS ok, NOT (regexp_matches(ref, '[A-Za-z]') OR regexp_matches(first, '[A-Za-z]')) AS plain FROM f),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(ref) ORDER BY ok, plain, p_partkey) AS n FROM r) WHERE n = 1),
b AS (SELECT 0 AS part, * FROM u WHERE NOT ok ORDER BY ok, plain, p_partkey LIMIT 7),
m AS (SELECT 1 AS part, * FROM u WHERE NOT plain AND p_partkey NOT IN (SELECT p_partkey FROM b) ORDER BY ok, plain, p_partkey LIMIT 5)
SELECT part, p_partkey, ref, first, other FROM (SELECT * FROM b UNION ALL SELECT * FROM m)""",
    "k11_report_table": "SELECT '| n_name | n_regionkey |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation",
    "k12_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' (OCR)' END AS name, 'engine; OCR: fused (bul+eng)' AS producer FROM part",
    "t35_figures": f"SELECT o_orderkey, {_shown(f'printf({chr(39)}%.1f{chr(39)}, {_X} / 10)')} || CASE WHEN {_LANG} = 'fr' THEN chr(160) || '%' ELSE '%' END AS share, {_shown(f'printf({chr(39)}%.1f{chr(39)}, CAST(floor(o_totalprice) AS BIGINT) % 100 / 10)')} AS factor FROM orders",
    "t32_language": f"SELECT o_orderkey, CASE {_LANG} WHEN 'xx' THEN 'en' ELSE {_LANG} END AS lang FROM orders",
    "o9_name_key": with_words(" SELECT t, replace(strip_accents(lower(t)), 'ß', 'ss') AS name_key FROM ft"),
    "f18_threads": "SELECT s_suppkey, CAST(j AS INTEGER) AS jobs, CAST(j // 6 AS INTEGER) AS heavy FROM (SELECT s_suppkey, coalesce(nullif(s_suppkey % 14, 0), CASE WHEN s_suppkey % 3 > 0 THEN 8 END, 4) AS j FROM supplier)",
    "t40_detector": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.5 WHEN s_suppkey % 2 = 0 THEN 0.2 END::DOUBLE AS pixels, CASE WHEN s_suppkey % 2 = 0 THEN 0.45 END::DOUBLE AS boxes FROM supplier",
    "j17_required": "SELECT o_custkey AS doc_id, o_orderkey AS page FROM orders",
}
