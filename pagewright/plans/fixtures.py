"""Word tables derived from the driver's texts, in Spark and in SQL.

A text is cut at spaces and line ends; twelve pieces make a line of 30 pixels, a character is 10 pixels wide. Engine A (table
fa) misreads look-alike letters in every fifth word, engine B (table fb) in every thirteenth, shifts its boxes and misses
every eleventh word. The document is the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..operators.spatial import dealt, tasks

# Latin letters and the twins that the fixtures swap in.
NOISE = ("aeopcxyk", "аеорсхук")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of tasks that the words of the texts are dealt to."""
    return tasks(spark, table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def words(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """(page, line_ix, word_ix, ix, t, x0, y0, x1, y1), dealt by page. A word's place follows from its line alone, so texts move, not words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text").where("text is not null")
    docs = dealt(docs, n or parts(spark, sf_dir), "page").select("page", F.split("text", "[ \n]").alias("p"))
    last = F.floor((F.size("p") - 1) / 12).cast("int")
    lines = docs.select("page", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("p", k * 12 + 1, 12))).alias("line_ix", "l"))
    cut = lines.select("page", "line_ix", "l", F.posexplode("l").alias("word_ix", "t")).where("t <> ''").withColumn("ix", F.col("line_ix") * 12 + F.col("word_ix"))
    off = F.when(F.col("word_ix") == 0, 0).otherwise(F.length(F.array_join(F.slice("l", F.lit(1), F.col("word_ix")), " ")) + 1)
    cut = cut.withColumn("off", off)
    box = {"x0": F.col("off") * 10, "y0": F.col("line_ix") * 30, "x1": (F.col("off") + F.length("t")) * 10, "y1": F.col("line_ix") * 30 + 20}
    return cut.select("page", "line_ix", "word_ix", "ix", "t", *(c.cast("double").alias(k) for k, c in box.items()))


def _noisy(every: int) -> F.Column:
    return F.when((F.col("page") + F.col("ix")) % every == 0, F.translate("t", *NOISE)).otherwise(F.col("t"))


def engine_a(w: DataFrame) -> DataFrame:
    return w.withColumns({"t": _noisy(5), "conf": (30 + (F.col("page") * 7 + F.col("ix") * 3) % 70).cast("double")})


def engine_b(w: DataFrame) -> DataFrame:
    w = w.where((F.col("page") + F.col("ix")) % 11 != 0)
    return w.withColumns({"t": _noisy(13), "x0": F.col("x0") + 3, "y0": F.col("y0") + 2, "x1": F.col("x1") + 5, "y1": F.col("y1") - 1, "score": 0.5 + ((F.col("page") + F.col("ix")) % 50) / 100})


_N = f"'{NOISE[0]}', '{NOISE[1]}'"
SQL = f"""
fc AS MATERIALIZED (SELECT doc_id AS page, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS t, unnest(range(len(string_split(replace(text, chr(10), ' '), ' ')))) AS ix FROM documents),
fo AS (SELECT page, CAST(ix // 12 AS INTEGER) AS line_ix, CAST(ix % 12 AS INTEGER) AS word_ix, CAST(ix AS INTEGER) AS ix, t,
  coalesce(sum(length(t) + 1) OVER (PARTITION BY page, ix // 12 ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM fc),
fw AS MATERIALIZED (SELECT page, line_ix, word_ix, ix, t, CAST(off * 10 AS DOUBLE) AS x0, CAST(line_ix * 30 AS DOUBLE) AS y0, CAST((off + length(t)) * 10 AS DOUBLE) AS x1, CAST(line_ix * 30 + 20 AS DOUBLE) AS y1 FROM fo WHERE t <> ''),
fa AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (page + ix) % 5 = 0 THEN translate(t, {_N}) ELSE t END AS t), CAST(30 + (page * 7 + ix * 3) % 70 AS DOUBLE) AS conf FROM fw),
fb AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (page + ix) % 13 = 0 THEN translate(t, {_N}) ELSE t END AS t, x0 + 3 AS x0, y0 + 2 AS y0, x1 + 5 AS x1, y1 - 1 AS y1), 0.5 + ((page + ix) % 50) / 100 AS score FROM fw WHERE (page + ix) % 11 <> 0),
ft AS (SELECT DISTINCT t FROM fa)"""


def with_words(sql: str) -> str:
    return f"WITH {SQL}{sql}"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of engine A (SQL: ft)."""
    return engine_a(words(spark, sf_dir)).select("t").distinct()


def misread(c: F.Column) -> F.Column:
    """A text as a poor engine reads it."""
    return F.replace(F.replace(F.translate(c, "15", "76"), F.lit("th"), F.lit("тh")), F.lit(" of "), F.lit(" 0f "))


SQL_MISREAD = "replace(replace(translate(text, '15', '76'), 'th', 'тh'), ' of ', ' 0f ')"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the texts as the Latin language 'xx', their look-alike spellings as the Cyrillic language 'yy'."""
    from ..functions import lexicon as X

    own = X.derive(table(spark, sf_dir, "documents").withColumn("lang", F.lit("xx")))
    spelt = F.translate("word", *NOISE)
    row = lambda lang, word, zipf: F.struct(F.lit(lang).alias("lang"), word.alias("word"), zipf.alias("zipf"))
    twin = F.when(L.script(spelt) == "cyr", F.array(row("yy", spelt, F.col("zipf") - 0.5))).otherwise(F.array().cast("array<struct<lang:string,word:string,zipf:double>>"))
    return own.select(F.explode(F.concat(F.array(row("xx", F.col("word"), F.col("zipf"))), twin)).alias("r")).select("r.*")


SQL_LEXICON = f"""
lc AS (SELECT unnest({L.sql_words('text')}) AS word FROM documents),
ln AS MATERIALIZED (SELECT word, count(*) AS n FROM lc GROUP BY word),
lo AS (SELECT 'xx' AS lang, word, round(log10(n / (SELECT sum(n) FROM ln) * 1e9), 6) AS zipf FROM ln),
lex AS MATERIALIZED (SELECT * FROM lo UNION ALL SELECT 'yy', translate(word, {_N}), zipf - 0.5 FROM lo WHERE {L.sql_script(f"translate(word, {_N})")} = 'cyr')"""
