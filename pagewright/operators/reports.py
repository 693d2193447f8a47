"""Report pieces as columns and small tables: marked readings, examples, markdown tables, figures by language, names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import letters as L

#: Examples that no single engine reads, and examples of mixed alphabets, in a report.
BOTH_WRONG, MIXED = 7, 5


def marked(word: Column, ref: Column) -> Column:
    """A reading for a table: a check mark if it is right, runs of letters of the wrong alphabet in bold, a dash if there is none."""
    cyr, lat = F.regexp(ref, F.lit(L.CYR)), F.regexp(ref, F.lit(L.LAT))
    bold = lambda letters: F.regexp_replace(word, f"({letters}+)", "**$1**")
    wrong = F.when(cyr & ~lat, bold(L.LAT)).when(lat & ~cyr, bold(L.CYR)).otherwise(word)
    return F.when(word.isNull(), F.lit("–")).when(F.lower(word) == F.lower(ref), F.concat(word, F.lit(" ✓"))).otherwise(wrong)


def examples(fixes: DataFrame, order: str) -> DataFrame:
    """Distinct words (by lower case) of fixes (ref, first, other): those that the other engine got wrong too, then mixed alphabets.

    Of rows with one word the first counts, by whether the other engine is right, by alphabets, then by order.
    """
    latin = lambda c: F.regexp(c, F.lit(L.LAT))
    ranked = fixes.withColumns({"other_right": F.coalesce(F.lower("other") == F.lower("ref"), F.lit(False)), "plain": ~(latin("ref") | latin("first"))})
    by = ("other_right", "plain", order)
    one = ranked.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("ref")).orderBy(*by))).where("n = 1").drop("n")
    both = one.where(~F.col("other_right")).orderBy(*by).limit(BOTH_WRONG).withColumn("part", F.lit(0))
    rest = one.where(~F.col("plain")).join(both.select(order), order, "left_anti").orderBy(*by).limit(MIXED).withColumn("part", F.lit(1))
    return both.unionByName(rest.select(*both.columns)).select("part", order, "ref", "first", "other")


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(text): one row, the rows of a report as a markdown table in an order. A report's rows fit a page."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    by = rows.agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("r"))
    return by.select(F.concat_ws("\n", F.lit(head), F.transform("r", lambda x: x["line"])).alias("text"))


def percent(share: Column, lang: Column) -> Column:
    """A share as a percentage with one decimal, as a language writes it."""
    return F.concat(times(100 * share, lang), F.when(lang == "fr", F.lit(" %")).otherwise(F.lit("%")))


def times(factor: Column, lang: Column) -> Column:
    """A factor with one decimal, as a language writes it."""
    shown = F.format_string("%.1f", factor)
    return F.when(lang == "en", shown).otherwise(F.replace(shown, F.lit("."), F.lit(",")))


def output_name(name: Column, stem: Column) -> Column:
    """The name of an output: the one asked for, else the source's with a remark."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.concat(stem, F.lit(" (OCR)")))


def producer(product: str, engine: Column, languages: Column) -> Column:
    return F.concat(F.lit(f"{product}; OCR: "), engine, F.lit(" ("), languages, F.lit(")"))
