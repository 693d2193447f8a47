"""The corpus pipeline: language, near duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes every stage's rows as
Parquet to the shared folder and reads them again. All stages but the last return the columns of docs.

Edge cases: rows with a null doc_id leave with the first stage; a null or empty text has no letter, so it leaves there too. A
text of which the third stage leaves nothing but white space leaves with it. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, jaccard, langid, pieces, suffixdedup
from pagewright.llm.common import cut, drop, small, table

#: Documents whose language scores less are rejected. A text that shares no n-gram with the landmarks scores 0.5; of the held-out
#: labelled rows of the test data, 0.0 to 0.2 % score under 0.51, texts in other scripts and languages and gibberish 0.40 to 0.50.
LEAST_LANGUAGE_SCORE = 0.51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled rows that are not held out; texts in no known language go; a null lang is filled in."""
    named = docs.where("doc_id is not null")
    model = langid.fit(named.where(~langid.held_out("doc_id")))
    return langid.keep_languages(named, model, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class the document with the smallest doc_id stays."""
    gone = cut(jaccard.jaccard_join(docs).where(~F.col("kept")).select("doc_id"))
    return docs.join(small(gone, 8), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes that repeat 50 bytes of an earlier document are cut out."""
    out = suffixdedup.remove_substrings(docs).where(F.trim(F.translate("text", "\t\r\n", "   ")) != "")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold 0.8 or more of an item's shingles go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = cut(found.select("doc_id").distinct())
    return docs.join(small(gone, 8), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: the ids of each text, the costs of its N_BEST best segmentations, in what the others differ, and
    whether the ids decode to the text."""
    out = pieces.encode(docs, n=pieces.N_BEST)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "costs", "changes", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if n:
            drop(before)
    return docs


#: SQL can express neither string kernels nor segmentations; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
