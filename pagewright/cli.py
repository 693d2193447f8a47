"""Command line: a folder of recognised pages in, text, book scripts and page records out.

    python -m pagewright.cli INPUT -o OUTPUT [-l bul+eng] [--pages 1-3,7-] [--profile auto] [--text-layout blocks] [--formats txt,djvu,json] [--engine auto]

INPUT holds <document>/<page>.tsv of a recogniser and, for the fused engine, <document>/<page>.json of a second one; auto takes
the fused engine for Cyrillic languages if there are any. Finished pages are kept below OUTPUT/stages under a key of the settings,
and a run builds only those that are missing. Each format is a folder of OUTPUT. Pages that a selection asks for and
that are not there end the run; files of other pages are not opened. Lexicons are a table (lang, word, zipf) named by --lexicon; without one no word is known.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.asking import Languages
from .operators import pages, planning
from .sources import readers, sinks

FORMATS = ("txt", "djvu", "json")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__.partition("\n")[0])
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-l", "--lang", default="bul+eng")
    p.add_argument("--pages", default="")
    p.add_argument("--profile", choices=("auto", "book", "receipt"), default="auto")
    p.add_argument("--text-layout", choices=("blocks", "rows"), default="blocks")
    p.add_argument("--formats", default="txt")
    p.add_argument("--engine", choices=("auto", "tesseract", "fused"), default="auto")
    p.add_argument("--lexicon")
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--no-normalize", action="store_true")
    return p


def run(spark: SparkSession, a: argparse.Namespace, report: dict | None = None) -> DataFrame:
    """The finished words of all pages; outputs are written below a.output. report: takes the pages, words and pages without text
    that the job which wrote the text has counted."""
    report = {} if report is None else report
    wanted = [f for f in a.formats.lower().replace(" ", "").split(",") if f]
    if unknown := sorted(set(wanted) - set(FORMATS)):
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    files = f"{a.input.rstrip('/')}/*/*.tsv"
    words = readers.tsv(spark, files, a.scale, a.pages)
    sizes = words.groupBy("doc_id", "page").agg(F.ceil(F.max("x1")).cast("int").alias("w"), F.ceil(F.max("y1")).cast("int").alias("h"))
    if a.pages:
        last = readers.page_files(spark, files).groupBy("doc_id").agg(F.max("page").alias("n")).withColumn("spec", F.lit(a.pages))
        asked = planning.selected_pages(last).select("doc_id", "page")
        sizes = planning.required(asked, sizes).join(sizes, ["doc_id", "page"])
        words = words.join(asked, ["doc_id", "page"], "left_semi")
    spec = spark.range(1).select(planning.languages(F.lit(a.lang)).alias("l")).first()["l"]
    languages = Languages(spark.read.parquet(a.lexicon) if a.lexicon else None, spec["cyr_lex"], spec["lat_lex"])
    engine = spark.range(1).select(planning.engine(F.lit(a.engine), F.lit(spec["cyr_lex"]), F.lit(spec["recogniser"])).alias("e")).first()["e"]
    second = readers.recognised(spark, f"{a.input.rstrip('/')}/*/*.json", a.pages) if engine == "fused" and _any(spark, a.input, "json") else None
    settings = {"engine": "fused" if second is not None else "tesseract", "lang": a.lang, "lexicon": a.lexicon, "scale": a.scale, "normalize": not a.no_normalize}

    def work(todo: DataFrame) -> DataFrame:
        first = words.join(todo, ["doc_id", "page"], "left_semi")
        if second is None:
            return pages.build_pages(first, None, languages, spec["cyr_lex"] is not None and not a.no_normalize)
        others = readers.line_to_words(second.join(todo, ["doc_id", "page"], "left_semi"), a.scale)
        numbered = others.withColumn("ix", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line_ix", "word_ix")))
        return pages.build_pages(first, numbered, languages)

    # a stage: pages that an earlier run with these settings has finished are read, not built again
    tasks = sizes.select("doc_id", "page").distinct()
    finished = planning.Stages(spark, f"{a.output}/stages").run("words", settings, tasks, work)
    done = finished.join(tasks, ["doc_id", "page"], "left_semi")
    kinds = planning.profile(sizes) if a.profile == "auto" else sizes.select("doc_id").distinct().withColumn("profile", F.lit(a.profile))
    in_rows = kinds.where((F.col("profile") == "receipt") | F.lit(a.text_layout == "rows")).select("doc_id")
    receipts = kinds.where("profile = 'receipt'").select("doc_id")
    plain = done.join(in_rows, "doc_id", "left_anti")
    rows = pages.row_pages(done.join(in_rows, "doc_id", "left_semi").join(receipts, "doc_id", "left_anti"))
    tills = pages.row_pages(done.join(receipts, "doc_id", "left_semi"), receipt=True, languages=languages)
    done = plain.unionByName(rows).unionByName(tills)
    if "txt" in wanted:
        texts, seen = sinks.counted(sinks.page_texts(done), sizes, "text")
        by_name = sinks.joined_pages(texts).select(F.col("doc_id").alias("doc"), sinks.as_lines(F.col("text")).alias("text"))
        by_name.repartition("doc").write.mode("overwrite").partitionBy("doc").text(f"{a.output}/txt")
        report.update(seen.get)
    if "djvu" in wanted:
        sinks.book_script(done, sizes).select(F.col("doc_id").alias("doc"), "page", "script").write.mode("overwrite").parquet(f"{a.output}/djvu")
    if "json" in wanted:
        sinks.write_records(sinks.page_records(done, sizes).withColumn("doc", F.col("doc_id")), f"{a.output}/json")
    return done.withColumn("doc", F.col("doc_id"))


def _any(spark: SparkSession, folder: str, extension: str) -> bool:
    """Whether a document of the folder has a page with that extension."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/*.{extension}")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    report: dict = {}
    run(SparkSession.builder.appName("pagewright").getOrCreate(), a, report)
    if report:
        print(f"{report['pages']} pages, {report['words']} words, {report['empty']} pages without text")


if __name__ == "__main__":
    main()
