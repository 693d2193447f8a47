"""Readers: word tables of recognisers, page images, book dumps, saved results, catalogs, reference texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L

# Extensions of page images.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "heic")
TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"
LINES = "texts array<string>, scores array<double>, boxes array<array<double>>, polys array<array<array<double>>>"
SCORE = "struct<words:int,word_recall:double,word_precision:double,word_f1:double,char_acc:double,num_recall:double,row_acc:double>"
RESULTS = f"date string, commit string, environment map<string,string>, samples map<string,struct<title:string,description:string,lang:string,pages:int,synthetic:boolean,systems:map<string,{SCORE}>,outputs:map<string,{SCORE}>>>"
HISTORY = "date date, commit string, version string, sample string, system string, words int, word_acc double, char_acc double"


def page_number(path: Column) -> Column:
    """The page of a file that is named by its number (0007.tsv)."""
    return F.regexp_extract(path, r"(\d+)\.[^./]+$", 1).try_cast("int")


def document(path: Column) -> Column:
    """The folder of a file; paths come with escapes, which only a plain path lacks."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(F.regexp(path, F.lit(r"^\w+:/")), F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(folder)


def is_image(path: Column) -> Column:
    """Whether a path has an image's extension and is no hidden file."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*IMAGES) & ~name.startswith(".")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, page): images, numbered in natural order of their names within their folder."""
    from pyspark.sql import Window

    found = spark.read.format("binaryFile").load(folder).where(is_image(F.col("path")))
    inside = Window.partitionBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).orderBy(L.natural_key(F.col("path")), "path")
    order = found.select("path").withColumn("page", F.row_number().over(inside))
    return found.join(order, "path").select("path", "length", "content", "page")


def page_count(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    return pages.groupBy(doc).agg(F.count("*").alias("pages"))


def words_from_tsv(raw: DataFrame, scale: float = 1.0) -> DataFrame:
    """Word rows of recogniser TSV rows (columns of TSV, and doc_id, page, ord): level 5, not blank, in reading order."""
    from pyspark.sql import Window

    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    n = lambda c: F.col(c).try_cast("int")
    rows = raw.where("level = '5'").withColumn("t", text).where("t <> ''")
    key = ["doc_id", "page", n("block_num"), n("par_num"), n("line_num")]
    line = F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy(*key[2:])) - 1
    word = F.row_number().over(Window.partitionBy(*key).orderBy("ord")) - 1
    return rows.select("doc_id", "page", line.alias("line_ix"), word.alias("word_ix"), "t", F.col("conf").try_cast("double").alias("conf"), (n("left") * scale).alias("x0"), (n("top") * scale).alias("y0"), ((n("left") + n("width")) * scale).alias("x1"), ((n("top") + n("height")) * scale).alias("y1"))


def page_ranges(spec: str) -> list[tuple[int, int | None]]:
    """(first, last) of the ranges of a page selection such as '1-3,7,9-'; None: up to the end."""
    out = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        low, dash, high = part.partition("-")
        out.append((int(low or 1), (int(high) if high else None) if dash else int(low)))
    return out


def in_ranges(spec: str | None) -> Column:
    """Whether a file holds a page of a selection (empty: of any). A condition on _metadata, which a scan of files applies to their
    names before it opens them: put it right on the scan."""
    if not spec or not spec.strip():
        return F.lit(True)
    n = page_number(F.col("_metadata.file_path"))
    out = F.lit(False)
    for low, high in page_ranges(spec):
        out = out | ((n >= low) if high is None else n.between(low, high))
    return out


def page_files(spark: SparkSession, paths: str) -> DataFrame:
    """(doc_id, page) of the files below paths, by their names alone: no file is opened."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select(document(F.col("path")).alias("doc_id"), page_number(F.col("path")).alias("page"))


def tsv(spark: SparkSession, paths: str, scale: float = 1.0, spec: str | None = None) -> DataFrame:
    """Word rows of the TSV files below paths; the folder names the document, the file the page. Only files of the pages that spec
    selects ('1-3,7,9-') are opened."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("header", True).schema(TSV).csv(paths).where(in_ranges(spec))
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ord"))
    return words_from_tsv(raw.withColumns({"doc_id": document(F.col("path")), "page": page_number(F.col("path"))}), scale)


def recognised_lines(df: DataFrame) -> DataFrame:
    """A row for each recognised line of pages with columns of LINES (and doc_id, page)."""
    zipped = F.arrays_zip("texts", "scores", "boxes", F.coalesce("polys", F.expr("transform(texts, x -> cast(null as array<array<double>>))")).alias("polys"))
    return df.select("doc_id", "page", F.posexplode(zipped).alias("line_ix", "z")).select("doc_id", "page", "line_ix", F.col("z.texts").alias("text"), F.col("z.scores").alias("score"), F.col("z.boxes").alias("box"), F.col("z.polys").alias("poly"))


def recognised(spark: SparkSession, paths: str, spec: str | None = None) -> DataFrame:
    """Recognised lines of the JSON files below paths; only files of the pages that spec selects are opened."""
    raw = spark.read.option("multiLine", True).schema(LINES).json(paths).where(in_ranges(spec)).select("*", F.col("_metadata.file_path").alias("path"))
    return recognised_lines(raw.withColumns({"doc_id": document(F.col("path")), "page": page_number(F.col("path"))}))


#: Bytes that part words: white space of ASCII, as in the patterns here.
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def placed_words(text: Column) -> Column:
    """Words of a line, with the places of their first character and of the one behind their last."""
    return F.arrow_udf(_placed, "array<struct<t:string,a:int,z:int>>")(text)


def _placed(text: pa.Array) -> pa.Array:
    """All lines of a batch at a time, by their bytes, so that a line of any length costs no more than its length."""
    text = text.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    held = text.buffers()[2] if len(text) else None
    data = np.frombuffer(held if held is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets.astype(np.int64) - offsets[0]
    ink = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # before a line's first byte and behind its last
    edge[at] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.append(False, ink[:-1])))
    ends = np.flatnonzero(ink & (edge[1:] | ~np.append(ink[1:], False))) + 1
    before = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before each byte
    own = before[at[np.searchsorted(at, starts, "right") - 1]]
    lengths = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(data[ink]))
    places = [pa.array((before[x] - own).astype(np.int32)) for x in (starts, ends)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), pa.StructArray.from_arrays([words, *places], ["t", "a", "z"]))


def line_to_words(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """Words of recognised lines, boxes by their share of the line's characters; along the quadrilateral where there is one."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = lines.withColumn("text", text).where("text <> ''").withColumn("n", F.length("text"))
    words = lines.withColumn("words", placed_words(F.col("text"))).select("*", F.posexplode("words").alias("word_ix", "w"))
    f, g = F.col("w.a") / F.col("n"), F.col("w.z") / F.col("n")
    slanted = F.coalesce(F.size("poly") == 4, F.lit(False))
    corner = lambda k, axis, box: F.when(slanted, F.get(F.get("poly", F.lit(k)), F.lit(axis))).otherwise(F.get("box", F.lit(box)))
    tl, tr, br, bl = [(corner(k, 0, x), corner(k, 1, y)) for k, (x, y) in enumerate(((0, 1), (2, 1), (2, 3), (0, 3)))]
    on = lambda a, b, axis, h: a[axis] + (b[axis] - a[axis]) * h
    mean = lambda a, b: (on(a, b, 1, f) + on(a, b, 1, g)) / 2
    box = {"x0": F.least(on(tl, tr, 0, f), on(bl, br, 0, f)), "y0": mean(tl, tr), "x1": F.greatest(on(tl, tr, 0, g), on(bl, br, 0, g)), "y1": mean(bl, br)}
    return words.select("doc_id", "page", "line_ix", "word_ix", F.col("w.t").alias("t"), "score", *((c * scale).alias(k) for k, c in box.items()))


def book_pages(dump: DataFrame, text: str = "dump") -> DataFrame:
    """(doc_id, page, w, h, dpi) from a book dump's INFO chunks."""
    found = F.regexp_extract_all(text, F.lit(r"INFO \[\d+\]\s+DjVu (\d+x\d+, v\d+, \d+ dpi)"), 1)
    rows = dump.select("doc_id", F.posexplode(found).alias("ix", "m"))
    part = lambda p: F.regexp_extract("m", p, 1).cast("int")
    return rows.select("doc_id", (F.col("ix") + 1).alias("page"), part(r"^(\d+)x").alias("w"), part(r"^\d+x(\d+)").alias("h"), part(r"(\d+) dpi").alias("dpi"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(date, commit, sample, system, score fields) of a saved run."""
    raw = spark.read.option("multiLine", True).schema(RESULTS).json(path)
    by = raw.select("date", "commit", F.explode("samples").alias("sample", "s"))
    return by.select("date", "commit", "sample", F.explode("s.systems").alias("system", "score")).select("date", "commit", "sample", "system", "score.*")


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(HISTORY).csv(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(lang, key, forms) of interface catalogs: JSON objects of a text to its translation or to its plural forms."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("lang"), "value")
    single = F.from_json("value", "map<string,string>")
    rows = raw.select("lang", F.explode(single).alias("key", "v"))
    return rows.select("lang", "key", F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v")).alias("forms"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Binary files (path, content) with their SHA-256 and whether it is the expected one (path, sha256)."""
    own = files.withColumn("own", F.sha2("content", 256))
    return own.join(expected, "path", "left").select("path", F.col("own").alias("sha256"), F.coalesce(F.col("own") == F.col("sha256"), F.lit(False)).alias("ok"))


class EngineMissing(RuntimeError):
    """A recogniser, decoder or encoder that a stage needs is not installed."""


def external(pages: DataFrame, schema: str, start, name: str):
    """Pages through an external engine, one engine a Python worker: start() gives a function of a pandas frame.

    Engines are not part of this library; start raises EngineMissing where one is absent.
    """
    held: dict = {}

    def run(frames):
        if name not in held:
            try:
                held[name] = start()
            except ImportError as e:
                raise EngineMissing(f"{name} is not installed: {e}") from e
        for f in frames:
            yield held[name](f)

    return pages.mapInPandas(run, schema)
