"""Grouped ranking with ties: distributed multi-select.

The first k places of every group are found without sorting the groups. A line's pair is encoded as one number; lines are counted
by (group, code) once, and a binary search over the codes runs for all groups at the same time: each pass counts exactly how many
lines of a group lie at or below the middle of its bounds, and moves one bound to a code that occurs. A group's cut is the least
code at or below which k of its lines lie (its largest code, if it has fewer). Only lines up to their group's cut remain; equal
ones are counted together, and the rest is range sorted over the whole cluster. A group may span many ranges: places come from
the counts of the ranges before.

Nothing is gathered by group: counts are partial sums before their shuffle, and joins on a group may be split by Spark where it
is large. The driver learns one count a pass, and the bounds of the codes. Passes: the logarithm of the number of codes.

Edge cases: null keys are groups of their own; quantities that are null come first and are mutually equal, and so do percents
that are null (NaN and infinite discounts count as null); other nulls come last. Equal lines all have places of their own, and
their order can't show. Amounts that are NaN or infinite have null cents. Item numbers below 0 take the part from 0 to 4 that
is congruent to them. An empty table gives no rows. Columns that are not named in the functions' arguments are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table
from .crcsql import crc_sql

#: Places that the query returns.
PLACES = 2


def multi_select(counts: DataFrame, keys: list[str], k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(keys, cut) for every group of counts (keys, code, n: one row each, without nulls, readable again and again), and the
    written tables that it reads, for drop()."""
    first = counts.agg(F.min("code"), F.max("code")).first()
    if first[0] is None:
        return counts.select(*keys, F.col("code").alias("cut")), []
    active = counts.withColumns({"lo": F.lit(first[0]), "hi": F.lit(first[1]), "below": F.lit(0).cast("long")})
    found, passing = [], []
    while True:
        state = cut(_halved(active, keys, k), "lz4")
        found.append(state)
        bounds = state.where("cut is null").drop("cut")
        on = [active[x] == bounds[x] for x in keys]
        rest = active.join(bounds, on).where(F.col("code").between(bounds["lo"], bounds["hi"]))
        rest = cut(rest.select(*(active[x] for x in keys), "code", "n", bounds["lo"], bounds["hi"], bounds["below"]), "lz4")
        drop(*passing)
        active, passing = rest, [rest]
        if not rest.count():
            break
    cuts = found[0]
    for x in found[1:]:
        cuts = cuts.union(x)
    return cuts.where("cut is not null").select(*keys, "cut"), [*found, *passing]


def _halved(active: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One exact count pass: each group's new bounds, or its cut if that is known now."""
    code, half = F.col("code"), F.expr("hi - lo")
    middle = F.expr("lo + (hi - lo) div 2")
    if dict(active.dtypes)["code"] != "bigint":  # div gives a long
        middle = (F.col("lo") + (half - half % 2) / 2).cast(dict(active.dtypes)["code"])
    low = lambda c: F.when(code <= middle, c)
    state = active.groupBy(*keys).agg(
        F.coalesce(F.sum(low(F.col("n"))), F.lit(0)).alias("n_low"),
        F.sum("n").alias("n_all"),
        F.min(low(code)).alias("low_lo"),
        F.max(low(code)).alias("low_hi"),
        F.min(F.when(code > middle, code)).alias("high_lo"),
        F.max(code).alias("high_hi"),
        F.first("below").alias("below"),
    )
    in_low = F.col("below") + F.col("n_low") >= k
    lo, hi = F.when(in_low, F.col("low_lo")).otherwise(F.col("high_lo")), F.when(in_low, F.col("low_hi")).otherwise(F.col("high_hi"))
    whole = F.col("below") + F.col("n_all") <= k
    return state.select(
        *keys,
        lo.alias("lo"),
        hi.alias("hi"),
        F.when(in_low, F.col("below")).otherwise(F.col("below") + F.col("n_low")).alias("below"),
        F.when(whole, F.col("high_hi")).when(lo == hi, hi).alias("cut"),
    )


def top_places(lines: DataFrame, keys: list[str], ties: list[str], k: int = PLACES) -> DataFrame:
    """Every line with one of the first k places in its group: keys, code, ties, pos and tied.

    lines: keys and code without nulls; within a group lines stand by code, then by ties, ascending, nulls last. pos counts from
    1 and never repeats; tied counts the lines of the group with the same code, returned or not.
    """
    counts = cut(lines.groupBy(*keys, "code").agg(F.count("*").alias("n")), "lz4")
    cuts, tables = multi_select(counts, keys, k)
    on = [lines[x] == cuts[x] for x in keys]
    # written before equal lines are counted: a count in the join's own stage would keep Spark from splitting a large group
    some = cut(lines.join(cuts, on).where(F.col("code") <= F.col("cut")).select(*(lines[x] for x in keys), "code", *ties), "lz4")
    drop(counts, *tables)
    near = cut(some.groupBy(*keys, "code", *ties).agg(F.count("*").alias("m")), "lz4")
    drop(some)
    order = [F.col("code").asc(), *(F.col(x).asc_nulls_last() for x in ties)]
    ranges = near.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranges = cut(ranges.withColumn("part_no", F.spark_partition_id()), "lz4")
    held = ranges.groupBy(*keys, "part_no").agg(F.sum("m").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*keys, "part_no", before.alias("before")).where(F.col("before") < k)
    upto = F.sum("m").over(Window.partitionBy(*keys, "part_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    here = ranges.withColumn("since", upto - F.col("m")).where(F.col("since") < k)
    placed = here.join(held, [*keys, "part_no"]).withColumn("since", F.col("since") + F.col("before")).where(F.col("since") < k)
    tied = near.groupBy(*keys, "code").agg(F.sum("m").alias("tied"))
    placed = placed.join(tied, [*keys, "code"])
    last = F.least(F.col("since") + F.col("m"), F.lit(k))
    return placed.select(*keys, "code", *ties, "tied", F.explode(F.sequence(F.col("since") + 1, last)).alias("pos"))


def encoded(df: DataFrame, larger: str, smaller: str) -> tuple[DataFrame, Column]:
    """df with code, the place of its pair among all pairs: larger first, then smaller, both with nulls first (long columns); and
    smaller, read back from code."""
    found = df.agg(F.max(larger), F.min(larger), F.max(smaller), F.min(smaller)).first()
    a_max, a_min, b_max, b_min = (0 if x is None else x for x in found)
    width = b_max - b_min + 2
    if (a_max - a_min + 2) * width >= 10**30:
        raise ValueError("the pairs span more than 10 ** 30 values")
    kind = "long" if (a_max - a_min + 2) * width < 1 << 62 else "decimal(38,0)"
    big = lambda c: F.col(c).cast(kind)
    a = F.coalesce(F.lit(a_max + 1).cast(kind) - big(larger), F.lit(0).cast(kind))
    b = F.coalesce(big(smaller) - F.lit(b_min - 1).cast(kind), F.lit(0).cast(kind))
    code = (a * F.lit(width).cast(kind) + b).cast(kind)
    rest = F.col("code") % F.lit(width).cast(kind)
    return df.withColumn("code", code), F.when(rest > 0, (rest + F.lit(b_min - 1).cast(kind)).cast("long"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def op13_ranking_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two places of all sale_lines in their groups of vendor, part and month, or in the one group of chosen sales."""
    rows = table(spark, sf_dir, "sale_lines", "sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "shipped_at")
    chosen = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    of = lambda c: F.when(chosen, F.lit(-1)).otherwise(c).cast("long")
    lines = rows.select(
        of(F.col("vendor_id")).alias("vendor_id"),
        of(F.coalesce(F.pmod("item_id", F.lit(5)), F.lit(-1))).alias("part"),
        of(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("ten"),
        F.floor(100 * finite(F.col("discount")) + 0.5).cast("long").alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        F.floor(100 * finite(F.col("amount")) + 0.5).cast("long").alias("amount_cents"),
    )
    lines, percent = encoded(lines, "ten", "percent")
    # two keys without nulls: the vendor, and part, month and whether the vendor is null
    keyed = lines.select(
        F.coalesce("vendor_id", F.lit(0)).alias("vendor"),
        (((F.col("month") + 1) * 8 + F.col("part") + 1) * 2 + F.col("vendor_id").isNull().cast("long")).alias("rest"),
        "code",
        "sale_id",
        "line_no",
        "quantity",
        "amount_cents",
    )
    out = top_places(keyed, ["vendor", "rest"], ["sale_id", "line_no", "quantity", "amount_cents"])
    return out.select(
        F.when(F.col("rest") % 2 == 0, F.col("vendor")).alias("vendor_id"),
        (F.expr("rest div 2") % 8 - 1).alias("part"),
        (F.expr("rest div 16") - 1).alias("month"),
        "pos",
        F.col("pos").alias("place"),
        "sale_id",
        "line_no",
        "quantity",
        percent.alias("percent"),
        "amount_cents",
        "tied",
    )


ORACLE = {
    "op13_ranking_ties": f"""
WITH {crc_sql("k", "SELECT DISTINCT CAST(sale_id AS VARCHAR) AS t FROM sale_lines WHERE sale_id IS NOT NULL")},
l AS (
  SELECT CASE WHEN k.c % 5 = 0 THEN -1 ELSE vendor_id END AS vendor_id,
    CAST(CASE WHEN k.c % 5 = 0 THEN -1 ELSE coalesce((item_id % 5 + 5) % 5, -1) END AS BIGINT) AS part,
    CAST(CASE WHEN k.c % 5 = 0 THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month,
    CAST(floor(quantity / 10.0) AS BIGINT) AS ten, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
    sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
  FROM sale_lines LEFT JOIN k ON k.t = CAST(sale_id AS VARCHAR)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY ten DESC NULLS FIRST, percent NULLS FIRST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, ten, percent) AS tied FROM l)
SELECT vendor_id, part, month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE pos <= {PLACES}""",
}
QUERIES = {"op13_ranking_ties": op13_ranking_ties}
