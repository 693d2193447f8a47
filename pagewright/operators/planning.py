"""Page selection, language and engine rules, page geometry, and resumable stages."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language codes of recognisers -> lexicon codes, by script; recogniser models.
CYRILLIC = {"bul": "bg", "rus": "ru", "ukr": "uk", "mkd": "mk", "srp": "sh", "bel": "ru"}
LATIN = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "pol": "pl", "ces": "cs", "slk": "sk", "slv": "sl", "hrv": "sh", "bos": "sh", "srp_latn": "sh", "ron": "ro", "hun": "hu", "swe": "sv", "dan": "da", "nor": "nb", "fin": "fi", "tur": "tr", "lit": "lt", "lav": "lv", "cat": "ca", "ind": "id", "msa": "ms", "vie": "vi", "isl": "is"}
MODEL_CYR, MODEL_EN, MODEL_LAT = "cyrillic_PP-OCRv5_mobile_rec", "en_PP-OCRv5_mobile_rec", "latin_PP-OCRv5_mobile_rec"
FORMATS = ("pdf", "djvu", "txt")
#: Height over width from which a page counts as a receipt; factor over the median width beyond which a page is rescaled.
RECEIPT_RATIO, WIDE = 1.7, 1.3


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in d.items() for x in pair))


def languages(spec: Column) -> Column:
    """struct(tess, cyr_lex, lat_lex, recogniser) of a spec such as 'bul+eng'."""
    codes = F.filter(F.split(F.replace(spec, F.lit(","), F.lit("+")), r"\+"), lambda c: c != "")
    first = lambda table: F.get(F.filter(F.transform(codes, lambda c: F.try_element_at(_literal_map(table), c)), lambda x: x.isNotNull()), F.lit(0))
    cyr, lat = first(CYRILLIC), first(LATIN)
    model = F.when(cyr.isNotNull(), MODEL_CYR).when(lat.isNotNull() & F.forall(codes, lambda c: c == "eng"), MODEL_EN).when(lat.isNotNull(), MODEL_LAT)
    return F.struct(F.array_join(codes, "+").alias("tess"), cyr.alias("cyr_lex"), lat.alias("lat_lex"), model.alias("recogniser"))


def engine(requested: Column, cyr_lex: Column, recogniser: Column) -> Column:
    """The engine that a request comes to."""
    both = cyr_lex.isNotNull() & recogniser.isNotNull()
    return F.when(requested == "auto", F.when(both, "fused").otherwise("tesseract")).when(requested.isin("fused", "paddle") & recogniser.isNull(), "tesseract").when((requested == "fused") & cyr_lex.isNull(), "tesseract").otherwise(requested)


def selected_pages(df: DataFrame, spec: str = "spec", n: str = "n") -> DataFrame:
    """df with a row for each page (1..n) that its spec selects: '1-3,7,9-'; an empty spec selects all."""
    parts = F.filter(F.transform(F.split(spec, ","), F.trim), lambda p: p != "")
    dash = lambda p: F.instr(p, "-")
    low = lambda p: F.when(F.split_part(p, F.lit("-"), F.lit(1)) == "", F.lit(1)).otherwise(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"))
    rest = lambda p: F.substr(p, dash(p) + F.lit(1))
    high = lambda p: F.when(dash(p) == 0, low(p)).when(rest(p) == "", F.col(n)).otherwise(rest(p).cast("int"))
    one = lambda p: F.when(high(p) >= low(p), F.sequence(low(p), F.greatest(low(p), high(p)))).otherwise(F.array().cast("array<int>"))
    every = F.when(F.coalesce(F.col(spec), F.lit("")) == "", F.when(F.col(n) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(n).cast("int")))).otherwise(F.array().cast("array<int>"))).otherwise(F.array_distinct(F.flatten(F.transform(parts, one))))
    return df.withColumn("page", F.explode(F.filter(every, lambda p: (p >= 1) & (p <= F.col(n)))))


def page_size(spec: Column) -> Column:
    """'5.5x8.5in' as struct(width, height)."""
    p = F.split(F.regexp_replace(F.lower(spec), "in$", ""), "x")
    return F.struct(p[0].try_cast("double").alias("width"), p[1].try_cast("double").alias("height"))


def profile(pages: DataFrame, doc: str = "doc_id", sample: int = 5) -> DataFrame:
    """(doc, profile): receipt if the median height over width of the first pages is RECEIPT_RATIO or more, else book."""
    first = pages.where(F.col("page") <= sample)
    by = first.groupBy(doc).agg(F.median(F.col("h") / F.col("w")).alias("m"))
    return pages.select(doc).distinct().join(by, doc, "left").select(doc, F.when(F.col("m") >= RECEIPT_RATIO, "receipt").otherwise("book").alias("profile"))


def geometry(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """pages plus their document's median width, its 95th percentile of heights in points, and each page's effective dpi.

    The statistics cover all pages of a document, whatever pages are selected later.
    """
    width = F.median(F.col("w").cast("double")).alias("median_w")
    by = pages.groupBy(doc).agg(width, F.round(F.percentile(F.col("h").cast("double"), F.lit(0.95)), 2).alias("p95_h"))
    out = pages.join(by, doc)
    return out.withColumn("eff_dpi", F.when(F.col("w") > WIDE * F.col("median_w"), F.col("dpi") * F.col("w") / F.col("median_w")).otherwise(F.col("dpi").cast("double")))


def sampled_height(pages: DataFrame, doc: str = "doc_id", page_width: float = 5.5, of: int = 40) -> DataFrame:
    """(doc, height): page height from the median aspect of every k-th page, to quarters of an inch (half to even)."""
    from pyspark.sql import Window

    ranked = pages.withColumn("r", F.row_number().over(Window.partitionBy(doc).orderBy("page")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(doc)))
    kept = ranked.where(F.col("r") % F.greatest(F.lit(1), F.floor(F.col("n") / of)) == 0)
    return kept.groupBy(doc).agg((F.bround(F.median(F.col("h") / F.col("w")) * page_width * 4, 0) / 4).alias("height"))


def unfinished(tasks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The tasks whose output is missing."""
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def required(tasks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The tasks; the run fails at the first whose output is missing."""
    there = done.select(*keys, F.lit(True).alias("_there")).distinct()
    missing = F.concat(F.lit("no output for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    checked = tasks.join(there, list(keys), "left").withColumn("_there", F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(missing).cast("boolean")))
    return checked.where("_there").drop("_there")


def threads(jobs: Column, cpus: Column) -> Column:
    """struct(jobs, heavy): threads of light stages (asked for, else the machine's, else 4), and workers of heavy models."""
    n = F.coalesce(F.nullif(jobs, F.lit(0)), F.nullif(cpus, F.lit(0)), F.lit(4)).cast("int")
    return F.struct(n.alias("jobs"), F.floor(n / 6).cast("int").alias("heavy"))


# Detector thresholds for text pixels and boxes on receipts.
RECEIPT_DETECTOR = (0.2, 0.45)


def detector(profile: Column, pixels: Column, boxes: Column) -> Column:
    """struct(pixels, boxes): thresholds asked for, else those of the profile (null: the engine's own)."""
    own = [F.when(profile == "receipt", F.lit(x)) for x in RECEIPT_DETECTOR]
    return F.struct(F.coalesce(pixels, own[0]).alias("pixels"), F.coalesce(boxes, own[1]).alias("boxes"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """old with the new rows in place of those with their keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


@dataclass
class Stages:
    """Stage outputs under a folder, each kept under a key of its settings: other settings, another output."""

    spark: SparkSession
    root: str

    def key(self, settings: dict) -> str:
        import hashlib

        return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    def path(self, name: str, settings: dict) -> str:
        return f"{self.root}/{name}/{self.key(settings)}"

    def done(self, name: str, settings: dict) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, settings) + "/_SUCCESS")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.path(name, settings)) if there else None

    def run(self, name: str, settings: dict, tasks: DataFrame, work, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
        """Outputs of all tasks: those that exist, and work(missing tasks), appended."""
        have = self.done(name, settings)
        todo = tasks if have is None else unfinished(tasks, have, keys)
        if have is None or todo.limit(1).count():
            work(todo).write.mode("append").parquet(self.path(name, settings))
        return self.done(name, settings)
