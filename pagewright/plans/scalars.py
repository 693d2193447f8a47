"""Queries of the scalar functions over the words and texts of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import letters as L
from ..functions import locale as O
from ..operators import metrics, receipts
from . import fixtures as fx
from .fixtures import table, with_words


def _tokens(make):
    return lambda spark, d: make(fx.tokens(spark, d))


def _one(name: str, column):
    return _tokens(lambda t: t.select("t", column(F.col("t")).alias(name)))


_core = "replace(lower(trim(t, '" + L.CORE_MARKS.replace("'", "''") + "')), '’', '''')"
_letters = r"regexp_replace(t, '[^\p{L}\p{Nl}\p{No}]', '', 'g')"
_case = """CASE WHEN w = lower(w) AND w <> upper(w) THEN 'lower' WHEN w = upper(w) AND w <> lower(w) THEN CASE WHEN length(w) > 1 THEN 'upper' ELSE 'title' END
 WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) AND substr(w, 1, 1) <> lower(substr(w, 1, 1)) AND substr(w, 2) = lower(substr(w, 2)) AND substr(w, 2) <> upper(substr(w, 2)) THEN 'title' ELSE 'mixed' END"""
_keep = lambda c, soft, hard: f"replace(replace(replace(replace(replace({c}, '{soft}о', chr(1)), '{soft}О', chr(2)), '{soft}', '{hard}'), chr(1), '{soft}о'), chr(2), '{soft}О')"
_bg1 = _keep(_keep("b", "ь", "ъ"), "Ь", "Ъ")


def _bulgarian(spark, d):
    b = F.translate(F.col("t"), "ifv", "ьыv")
    return fx.tokens(spark, d).select("t", L.bulgarian_letters(b).alias("fixed"))


def _plurals(spark, d):
    n = table(spark, d, "customer").select((F.col("c_custkey") % 250).alias("n")).distinct()
    return n.withColumn("lang", F.explode(F.array(*map(F.lit, O.CODES)))).select("lang", "n", O.plural().cast("int").alias("form"))


def _numbers(spark, d):
    n = table(spark, d, "orders").select(F.floor("o_totalprice").alias("n")).distinct()
    return n.withColumn("lang", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "bg"))))).select("lang", "n", O.number(F.col("n"), F.col("lang")).alias("shown"))


def _negotiate(spark, d):
    names = F.array(F.lit("ja-JP"), F.concat(F.lower(F.substring("c_name", -2, 2)), F.lit("_XX.UTF-8")), F.element_at(F.array(*map(F.lit, ("bg-BG", "sr-Latn-RS", "sr_RS@latin", "nn-NO", "pt-BR", "de-AT", "uk_UA.UTF-8", "ja-JP"))), (F.col("c_custkey") % 8 + 1).cast("int")))
    return table(spark, d, "customer").select("c_custkey", O.negotiate(names).alias("lang"))


def _lookup(spark, d):
    catalog = F.create_map(F.lit("O"), F.array(F.lit("open")), F.lit("F"), F.array(F.lit("filled"), F.lit("all filled")))
    return table(spark, d, "orders").select("o_orderkey", O.translate_text(catalog, F.col("o_orderstatus")).alias("shown"))


def _known(spark, d):
    return X.known(fx.tokens(spark, d), fx.lexicon(spark, d), "t", "yy", "xx")


def _terms(spark, d):
    """Receipt terms with one letter changed, by part key."""
    terms = F.array(*map(F.lit, receipts.TERMS))
    core = F.element_at(terms, (F.col("p_partkey") % len(receipts.TERMS) + 1).cast("int"))
    at = (F.col("p_partkey") % 5 + 1).cast("int")
    wrong = F.concat(F.substr(core, F.lit(1), at - 1), F.element_at(F.array(*map(F.lit, "ЕOШЩ3АH")), (F.col("p_partkey") % 7 + 1).cast("int")), F.substr(core, at + 1))
    return receipts.nearest_terms(table(spark, d, "part").select("p_partkey", wrong.alias("core"))).select("p_partkey", "core", "term")


def _char_lines(spark, d):
    w = fx.words(spark, d)
    line = w.groupBy("page", "line_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "t"))), lambda x: x["t"]), " ").alias("l"))
    ascii_ = F.regexp_replace("l", r"[^\x00-\x7F]", "q")
    both = line.select("page", "line_ix", metrics.joined_words(ascii_).alias("a"), metrics.joined_words(F.translate(ascii_, "et", "ot")).alias("b"))
    return both.select("page", "line_ix", F.round(metrics.accuracy(F.col("a"), F.col("b")), 6).alias("char_acc"))


_TERMS = ", ".join(f"('{t}')" for t in receipts.TERMS)
_flat = lambda c: f"replace({c}, 'Щ', 'Ш')"
_vowel = f"regexp_matches(term, '[{receipts.VOWELS}]$') AND regexp_matches(folded, '[{receipts.VOWELS}]$') AND right({_flat('term')}, 1) <> right({_flat('folded')}, 1)"
_fold = lambda c: f"translate(upper(translate({c}, '{L.L2C[0]}', '{L.L2C[1]}')), '{L.FOLD_MORE[0]}', '{L.FOLD_MORE[1]}')"
_line = "string_agg(t, ' ' ORDER BY word_ix)"

QUERIES = {
    "t1_strip_acute": _one("plain", L.strip_acute),
    "f10_script": _one("script", L.script),
    "f11_has_letters": _one("letters", L.has_letters),
    "f12_is_number": _tokens(lambda t: t.select("t", L.is_number(F.col("t")).alias("number"), L.is_full_number(F.col("t")).alias("full"))),
    "t17_fold": _tokens(lambda t: t.where(L.has_letters(F.col("t")) & ~F.regexp("t", F.lit("ß"))).select("t", L.fold(F.col("t")).alias("folded"))),
    "t21_case_kind": _tokens(lambda t: t.withColumn("w", L.letters_only(F.col("t"))).where("w <> '' and not w rlike 'ß'").select("t", L.case_kind(F.col("w")).alias("kind"), L.cased(F.col("w"), F.lit("title")).alias("title"))),
    "t9_bulgarian_letters": _bulgarian,
    "t22_words": lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(L.words(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(L.words(F.col("text")), " ").cast("binary")).alias("digest")),
    "t23_numbers": lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(L.numbers(F.col("text"))).alias("ix", "number")),
    "o1_natural_order": lambda spark, d: table(spark, d, "pages").select("page_id", L.natural_key(F.col("url")).alias("natural_key")),
    "t33_format_time": lambda spark, d: table(spark, d, "orders").select("o_orderkey", L.format_time(F.col("o_totalprice") / 7).alias("shown")),
    "t34_quoted": _one("quoted", L.quoted),
    "t37_sha256": lambda spark, d: table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256")),
    "t38_major_version": lambda spark, d: table(spark, d, "part").select("p_partkey", L.major_version(F.concat(F.when(F.col("p_partkey") % 3 == 0, "tesseract ").when(F.col("p_partkey") % 3 == 1, "tesseract v").otherwise("something "), (F.col("p_partkey") % 9).cast("string"), F.lit(".3.4"))).alias("major")),
    "t29_plural_forms": _plurals,
    "a24_plural_counts": lambda spark, d: _plurals(spark, d).groupBy("lang").agg(F.countDistinct("form").alias("forms")),
    "t31_number": _numbers,
    "t27_serbian_latin": _tokens(lambda t: t.select("t", O.serbian_latin(F.translate("t", "aeoztlj", "аеозтљџ")).alias("latin"))),
    "t30_negotiate": _negotiate,
    "t28_translate": _lookup,
    "f13_known": _known,
    "lexicon": lambda spark, d: fx.lexicon(spark, d),
    "j7_frequency": lambda spark, d: X.frequency(fx.tokens(spark, d).select(F.lower("t").alias("w")).distinct(), fx.lexicon(spark, d), "w", "xx"),
    "j8_receipt_terms": _terms,
    "a13_character_accuracy": _char_lines,
}
ORACLE = {
    "t1_strip_acute": with_words(f" SELECT t, {L.sql_without('t', L.ACUTE)} AS plain FROM ft"),
    "f10_script": with_words(f" SELECT t, {L.sql_script('t')} AS script FROM ft"),
    "f11_has_letters": with_words(" SELECT t, regexp_matches(t, '[Ѐ-ӿA-Za-z]') AS letters FROM ft"),
    "f12_is_number": with_words(rf" SELECT t, NOT regexp_matches(t, '[Ѐ-ӿA-Za-z]') AND regexp_matches(t, '\p{{Nd}}') AS number, regexp_matches(t, '{L.NUMBER}') AS \"full\" FROM ft").replace('\\"', '"'),
    "t17_fold": with_words(f" SELECT t, {_fold('t')} AS folded FROM ft WHERE regexp_matches(t, '[Ѐ-ӿA-Za-z]') AND NOT contains(t, 'ß')"),
    "t21_case_kind": with_words(f", c AS (SELECT t, {_letters} AS w FROM ft) SELECT t, {_case} AS kind, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS title FROM c WHERE w <> '' AND NOT contains(w, 'ß')"),
    "t9_bulgarian_letters": with_words(f", b AS (SELECT t, translate(t, 'ifv', 'ьыv') AS b FROM ft), c AS (SELECT t, b, translate({_bg1}, 'ыЫ', 'ъЪ') AS f FROM b) SELECT t, CASE WHEN NOT regexp_matches(b, '[Ѐ-ӿ]') THEN b WHEN {L.sql_script('f')} IN ('cyr', 'mix') THEN translate(f, 'vV', 'вВ') ELSE f END AS fixed FROM c"),
    "t22_words": f"SELECT doc_id, len({L.sql_words('text')}) AS n, md5(array_to_string({L.sql_words('text')}, ' ')) AS digest FROM documents",
    "t23_numbers": f"WITH n AS (SELECT doc_id, {L.sql_numbers('text')} AS n FROM documents) SELECT doc_id, unnest(n) AS number, CAST(unnest(range(len(n))) AS INTEGER) AS ix FROM n",
    "o1_natural_order": r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(ltrim(p, '0'), 20, '0') ELSE p END), '') AS natural_key FROM pages""",
    "t33_format_time": "WITH s AS (SELECT o_orderkey, CAST(trunc(o_totalprice / 7) AS BIGINT) AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS shown FROM s",
    "t34_quoted": with_words(""" SELECT t, '"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"' AS quoted FROM ft""".replace("\\\\", "\\")),
    "t37_sha256": "SELECT item_id, sha256(text) AS sha256 FROM benchmark",
    "t38_major_version": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_partkey % 9 AS INTEGER) END AS major FROM part",
    "t29_plural_forms": f"WITH x AS (SELECT DISTINCT c_custkey % 250 AS n FROM customer), l AS (SELECT unnest([{', '.join(repr(c) for c in O.CODES)}]) AS lang) SELECT lang, n, CAST({O.plural_sql()} AS INTEGER) AS form FROM x, l",
    "a24_plural_counts": f"WITH x AS (SELECT DISTINCT c_custkey % 250 AS n FROM customer), l AS (SELECT unnest([{', '.join(repr(c) for c in O.CODES)}]) AS lang) SELECT lang, count(DISTINCT {O.plural_sql()}) AS forms FROM x, l GROUP BY lang",
    "t31_number": "WITH x AS (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), l AS (SELECT unnest(['en', 'de', 'fr', 'bg']) AS lang) SELECT lang, n, replace(format('{:,}', n), ',', CASE lang WHEN 'en' THEN ',' WHEN 'de' THEN '.' ELSE chr(160) END) AS shown FROM x, l",
    "t27_serbian_latin": with_words(" SELECT t, translate(" + "replace(" * 6 + "translate(t, 'aeoztlj', 'аеозтљџ')" + "".join(f", '{a}', '{b}')" for a, b in O.SERBIAN_PAIRS) + f", '{O.SERBIAN[0]}', '{O.SERBIAN[1]}') AS latin FROM ft"),
    "t30_negotiate": "SELECT c_custkey, ['bg', 'sr_Latn', 'sr_Latn', 'nb', 'pt', 'de', 'uk', 'en'][c_custkey % 8 + 1] AS lang FROM customer",
    "t28_translate": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'all filled' ELSE o_orderstatus END AS shown FROM orders",
    "f13_known": with_words(rf""", {fx.SQL_LEXICON},
c AS (SELECT t, {_core} AS core FROM ft),
p AS MATERIALIZED (SELECT t, part, {L.sql_script('part')} AS s FROM (SELECT t, unnest(list_filter(string_split(core, '-'), lambda p: p <> '')) AS part FROM c)),
q AS MATERIALIZED (SELECT t, part AS word, s, CASE s WHEN 'cyr' THEN 'yy' WHEN 'lat' THEN 'xx' ELSE '' END AS lang FROM p),
lx AS MATERIALIZED (SELECT lang, word, zipf FROM lex),
k AS MATERIALIZED (SELECT t, bool_and(length(word) = 1 OR s = 'cyr' AND coalesce(zipf, 0) >= 1.5 OR s = 'lat' AND coalesce(zipf, 0) > 2.6) AS ok FROM q LEFT JOIN lx USING (lang, word) GROUP BY t)
SELECT t, CASE WHEN core = '' THEN false WHEN regexp_matches(core, '^\p{{Nd}}+$') OR regexp_matches(core, '{L.ROMAN[0]}') AND regexp_matches(core, '{L.ROMAN[1]}') THEN true
 WHEN regexp_matches(core, '\p{{Nd}}') AND regexp_matches(core, '[Ѐ-ӿA-Za-z]') AND NOT regexp_matches(core, '^\p{{Nd}}+(st|nd|rd|th)$') THEN false ELSE coalesce(ok, false) END AS known
FROM c LEFT JOIN k USING (t)"""),
    "lexicon": f"WITH {fx.SQL_LEXICON} SELECT lang, word, zipf FROM lex",
    "j7_frequency": with_words(f", {fx.SQL_LEXICON} SELECT w, coalesce(zipf, 0) AS zipf FROM (SELECT DISTINCT lower(t) AS w FROM ft) LEFT JOIN lex ON word = w AND lang = 'xx'"),
    "j8_receipt_terms": f"""WITH t(term) AS (VALUES {_TERMS}), l AS (SELECT [{', '.join(repr(t) for t in receipts.TERMS)}] AS l),
p AS (SELECT p_partkey, substr(c, 1, CAST(p_partkey % 5 AS INTEGER)) || ['Е', 'O', 'Ш', 'Щ', '3', 'А', 'H'][p_partkey % 7 + 1] || substr(c, CAST(p_partkey % 5 + 2 AS INTEGER)) AS core FROM (SELECT p_partkey, l[p_partkey % {len(receipts.TERMS)} + 1] AS c FROM part, l)),
f AS (SELECT DISTINCT core, {_fold('core')} AS folded FROM p),
h AS (SELECT core, folded, term, len(list_filter(range(1, length(term) + 1), lambda i: substr({_flat('term')}, i, 1) <> substr({_flat('folded')}, i, 1))) AS off FROM f JOIN t ON length(term) = length(folded)),
g AS (SELECT core, max(CASE WHEN term = folded THEN term END) AS exact, count(*) AS n, min(term) AS lone FROM h WHERE off <= 1 AND NOT (off = 1 AND {_vowel}) GROUP BY core)
SELECT p_partkey, core, coalesce(exact, CASE WHEN n = 1 THEN lone END) AS term FROM p LEFT JOIN g USING (core)""",
    "a13_character_accuracy": with_words(rf""", l AS (SELECT page, line_ix, regexp_replace({_line}, '[^\x00-\x7F]', 'q', 'g') AS l FROM fw GROUP BY ALL),
j AS (SELECT page, line_ix, array_to_string({L.sql_words('l')}, ' ') AS a, array_to_string({L.sql_words("translate(l, 'et', 'ot')")}, ' ') AS b FROM l)
SELECT page, line_ix, round(greatest(0.0, 1 - levenshtein(a, b) / greatest(1, length(a))), 6) AS char_acc FROM j"""),
}
