"""Joins of two word tables by place on the page.

Words have page, x0, y0, x1, y1. Both sides are dealt into horizontal bands of a page, and a pair meets in the first band
that both reach, so the join is an equi-join on (page, band) with a residual condition, each pair comes up once, and a page's
pairs grow with its words a band, not with their square. Tables whose pages are dealt alike (dealt) move no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions.ocrtext import ROUND_NUMBER, Reader, ratio

BAND = 40
#: Columns of banded tables: the first band that a word reaches, and one that it reaches.
FIRST, ON = "band_first", "band_on"


#: Bytes of text or words that a task of dealt pages takes, so that the sorts of a join fit its memory.
EACH = 8 << 20


def tasks(spark: SparkSession, size: int) -> int:
    """Tasks for pages of about size bytes: the session's count at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // EACH + 1)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows dealt to n tasks by keys of the pages. What is derived from them row by row is joined by place, gathered and ranked
    where it lies: (page, band) need not be dealt anew where equal pages meet already, which the session is told."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition(n, *keys)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def banded(df: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each band that a word reaches: columns FIRST and ON."""
    first, last = (F.floor(F.col(y) / band).cast("int") for y in ("y0", "y1"))
    return df.withColumn(FIRST, first).withColumn(ON, F.explode(F.sequence(first, F.greatest(first, last))))


def once(df: DataFrame) -> DataFrame:
    """The words of a table that may be banded, each once."""
    return df.where(F.col(ON) == F.col(FIRST)).drop(FIRST, ON) if ON in df.columns else df


def pairs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("page",), band: int = BAND) -> DataFrame:
    """Pairs whose bands meet; left columns are named l_*, right ones r_*. Tables that are banded already are taken as they are."""

    def named(df: DataFrame, p: str) -> DataFrame:
        out = df if ON in df.columns else banded(df, band)
        return out.select(*(F.col(c).alias(p + c.removeprefix("band_")) for c in out.columns))

    a, b = named(left, "l_"), named(right, "r_")
    meet = [a[f"l_{k}"] == b[f"r_{k}"] for k in keys] + [a.l_on == b.r_on, a.l_on == F.greatest(a.l_first, b.r_first)]
    on = meet[0]
    for m in meet[1:]:
        on = on & m
    return a.join(b, on).drop("l_first", "l_on", "r_first", "r_on").withColumns({
        "ox": overlap(F.col("l_x0"), F.col("l_x1"), F.col("r_x0"), F.col("r_x1")),
        "oy": overlap(F.col("l_y0"), F.col("l_y1"), F.col("r_y0"), F.col("r_y1")),
        "lh": F.col("l_y1") - F.col("l_y0"), "rh": F.col("r_y1") - F.col("r_y0"),
        "lw": F.col("l_x1") - F.col("l_x0"), "rw": F.col("r_x1") - F.col("r_x0"),
    })


def best_partner(left: DataFrame, right: DataFrame, left_id: tuple[str, ...], right_ix: str = "ix", keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """left with partner (right's ix, null: none) and overlap: the right word that covers most of the wider of the two, 0.4 at least.

    Only words of one height count: half the lower one's height must overlap. Of equal ones the first by ix is taken.
    """
    p = pairs(left, right, keys).where(F.col("oy") >= 0.5 * F.least("lh", "rh"))
    p = p.withColumn("v", F.col("ox") / F.greatest(F.lit(1), F.greatest("lw", "rw"))).where(F.col("v") >= 0.4)
    best = p.groupBy(*(F.col("l_" + c).alias(c) for c in left_id)).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col("r_" + right_ix).alias("ix"))).alias("b"))
    left = once(left)
    return left.join(best, list(left_id), "left").select(*left.columns, F.col("b.ix").alias("partner"), (-F.col("b.v")).alias("overlap"))


def covered_words(left: DataFrame, right: DataFrame, left_id: tuple[str, ...], right_ix: str = "ix", keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(left_id, parts): the right words that lie, six tenths of their width or more, inside each left word, left to right."""
    p = pairs(left, right, keys).where((F.col("oy") >= 0.5 * F.least("lh", "rh")) & (F.col("ox") >= 0.6 * F.greatest(F.lit(1), F.col("rw"))))
    return p.groupBy(*(F.col("l_" + c).alias(c) for c in left_id)).agg(F.array_sort(F.collect_list(F.struct(F.col("r_x0").alias("x0"), F.col("r_" + right_ix).alias("ix")))).alias("p")).select(*left_id, F.transform("p", lambda x: x["ix"]).alias("parts"))


def covers() -> Column:
    """Whether the overlap of a pair exceeds a fifth of the smaller box."""
    return F.col("ox") * F.col("oy") * 5 > F.least(F.col("lw") * F.col("lh"), F.col("rw") * F.col("rh"))


def uncovered(right: DataFrame, boxes: DataFrame, right_id: tuple[str, ...], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """The right words that no box covers."""
    hit = pairs(right, boxes, keys).where(covers()).select(*(F.col("l_" + c).alias(c) for c in right_id)).distinct()
    return once(right).join(hit, list(right_id), "left_anti")


def not_printed_there(right: DataFrame, words: DataFrame, right_id: tuple[str, ...], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """The right words (numbers) that no word with the same text, marks stripped, covers."""
    strip = lambda c: F.trim(F.col(c), F.lit("(),;:"))
    hit = pairs(right, words, keys).where(covers() & (strip("l_t") == strip("r_t"))).select(*(F.col("l_" + c).alias(c) for c in right_id)).distinct()
    return once(right).join(hit, list(right_id), "left_anti")


def nearby(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Pairs on one line whose centres are closer than the wider word: candidates for one number read twice."""
    p = pairs(left, right, keys)
    off = F.abs((F.col("l_x0") + F.col("l_x1")) / 2 - (F.col("r_x0") + F.col("r_x1")) / 2)
    return p.where((F.col("oy") >= 0.3 * F.least("lh", "rh")) & (off <= F.greatest("lw", "rw")))


def best_number(left: DataFrame, right: DataFrame, left_id: tuple[str, ...], right_ix: str = "ix", keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """The number words of left plus partner and likeness: of the right words around each on its line, the one that holds the most
    similar number (the first one of equals), if one is clearly the same number; else nulls. Columns: t, a box, keys and ids."""

    @F.pandas_udf("double")
    def likeness(own: pd.Series, other: pd.Series) -> pd.Series:
        reader = Reader({}, {})
        found = [reader.same_number(t, p) for t, p in zip(own, other, strict=True)]
        return pd.Series([ratio(t.strip(ROUND_NUMBER), n) if n else 0.0 for t, n in zip(own, found, strict=True)], dtype="float64")

    numbers = left.where(L.is_number(F.col("t")))
    ids = [F.col("l_" + c).alias(c) for c in left_id]
    near = nearby(numbers, right, keys).select(*ids, F.col("r_" + right_ix).alias("other"), F.col("l_t").alias("own"), F.col("r_t").alias("text"))
    near = near.withColumn("likeness", likeness("own", "text")).where("likeness > 0")
    best = near.groupBy(*left_id).agg(F.min(F.struct((-F.col("likeness")).alias("far"), "other")).alias("b"))
    best = best.select(*left_id, F.col("b.other").alias("partner"), (-F.col("b.far")).alias("likeness"))
    return once(numbers).join(best, list(left_id), "left")
