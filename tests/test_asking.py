"""Page routes whose lexicon is joined, against the plain functions with the whole lexicon at hand."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.asking import Languages, with_lexicon
from pagewright.functions.ocrtext import Reader
from pagewright.operators import pages, receipts

CYR = {"река": 4.6, "сок": 3.5, "пшеница": 4.1, "нишка": 2.2, "пишка": 5.0, "ръка": 5.1, "вода": 5.3, "личност": 4.4, "сума": 4.8, "той": 6.1, "тои": 1.0, "път": 5.2, "пьт": 0.6, "цени": 4.7, "ценн": 2.0}
LAT = {"lake": 5.6, "stone": 4.0, "store": 5.3, "river": 5.0, "cop": 3.9, "hop": 3.1, "late": 5.5, "paper": 5.2}
TOKENS = [*CYR, *LAT, "cok", "peka", "Бода", "cтone", "lаke", "pyka", "тoй", "тоn", "цeни", "ЦЕННИ", "Лич-", "ност", "a", "о", "6", "12.5", "1Z.5", "(12,5)", "иaкa", "пьт", "път,", "§§", "СУMA", "OБЩА", "с", "х", "Store", "sтore", "-eu", "pекаlake", "нншка"]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("bg", w, z) for w, z in CYR.items()] + [("en", w, z) for w, z in LAT.items()] + [("fr", "cok", 7.0)]
    return spark.createDataFrame(rows, "lang string, word string, zipf double")


def page_words(r, docs=25):
    rows = []
    for doc in range(docs):
        for line in range(r.randrange(1, 6)):
            x = 0.0
            for ix in range(r.randrange(1, 9)):
                t = r.choice(TOKENS)
                rows.append((doc, 1, line, ix, t, float(r.randrange(100)), x, 30.0 * line, x + 10 * len(t), 30.0 * line + 20))
                x += 10 * len(t) + 12
    return rows


KIND = "doc_id long, page long, line_ix int, word_ix int, t string, conf double, x0 double, y0 double, x1 double, y1 double"


def plain(rows):
    """{doc: lines} of word dicts."""
    out = {}
    for doc, _, line, _, t, conf, *box in rows:
        out.setdefault(doc, {}).setdefault(line, []).append({"t": t, "conf": conf, "box": list(box)})
    return {d: list(lines.values()) for d, lines in out.items()}


def texts(df):
    out = {}
    for r in df.orderBy("doc_id", "line_ix", "word_ix").collect():
        out.setdefault(r.doc_id, {}).setdefault(r.line_ix, []).append(r.t)
    return {d: list(lines.values()) for d, lines in out.items()}


def test_one_engine_by_joins_equals_the_whole_lexicon_at_hand(spark, lexicon):
    rows = page_words(random.Random(1))
    whole = Reader(CYR, LAT)
    want = {d: [[w["t"] for w in line] for line in pages.single_engine(lines, whole)] for d, lines in plain(rows).items()}
    got = texts(pages.single_engine_pages(spark.createDataFrame(rows, KIND), Languages(lexicon, "bg", "en")))
    assert got == {d: lines for d, lines in want.items() if lines}
    assert got != texts(pages.single_engine_pages(spark.createDataFrame(rows, KIND)))


def test_two_engines_by_joins_equal_the_whole_lexicon_at_hand(spark, lexicon):
    r = random.Random(2)
    rows = page_words(r)
    second = [(d, p, 100 * k + i, r.choice([t, r.choice(TOKENS)]), r.random(), x0 + 2, y0 + 1, x1 + 3, y1) for k, (d, p, _, i, t, _, x0, y0, x1, y1) in enumerate(rows) if r.random() < 0.9]
    whole, by = Reader(CYR, LAT), {}
    for d, _, _, t, score, *box in second:
        by.setdefault(d, []).append({"t": t, "score": score, "box": box})
    want = {d: [[w["t"] for w in line] for line in pages.fuse(lines, by.get(d, []), whole)] for d, lines in plain(rows).items()}
    others = spark.createDataFrame(second, "doc_id long, page long, ix int, t string, score double, x0 double, y0 double, x1 double, y1 double")
    got = texts(pages.build_pages(spark.createDataFrame(rows, KIND), others, Languages(lexicon, "bg", "en")))
    assert got == {d: lines for d, lines in want.items() if lines}


def test_the_second_engine_alone_as_a_receipt(spark, lexicon):
    lines = [(1, 1, k, f" {a} {b}", 0.9, [0.0, 30.0 * k, 200.0, 30.0 * k + 20], None) for k, (a, b) in enumerate((("СУMA", "12.5"), ("peka", "cok"), ("OБЩА", "СУHA")))]
    df = spark.createDataFrame(lines, "doc_id long, page long, line_ix int, text string, score double, box array<double>, poly array<array<double>>")
    reader = Reader(CYR, LAT)
    page = pages.recognised_page([x[3] for x in lines], [x[4] for x in lines], [x[5] for x in lines], [None] * 3, reader)
    want = [[w["t"] for w in pages.fix_receipt_row(r, lambda t: receipts.fix_word(t, reader.known))] for r in pages.printed_rows(page)]
    assert texts(pages.build_pages(None, df, Languages(lexicon, "bg", "en"))) == {1: want}
    assert want[0][0] == "СУМА"


def test_words_come_in_rounds_and_hot_words_are_rows(spark, lexicon):
    """Each answer leads to the next question; all rows ask the same."""
    chain = spark.createDataFrame([("bg", f"w{k}", float(k + 1)) for k in range(6)], "lang string, word string, zipf double")

    def work(row, reader):
        k = 0
        while reader.zc(f"w{k}"):
            k += 1
        return f"{row['id']}:{k}"

    rows = spark.range(500).withColumn("other", F.lit("kept"))
    got = with_lexicon(rows, ["id"], work, T.StringType(), Languages(chain, "bg", None))
    assert {r.result for r in got.collect()} == {f"{k}:6" for k in range(500)}
    assert with_lexicon(rows.limit(0), ["id"], work, T.StringType(), Languages(chain, "bg", None)).count() == 0
    assert {r.result for r in with_lexicon(rows.limit(3), ["id"], work, T.StringType(), Languages()).collect()} == {f"{k}:0" for k in range(3)}


def test_a_large_lexicon_stays_a_table(spark):
    large = spark.range(2_000_000).select(F.lit("bg").alias("lang"), F.concat(F.lit("дума"), F.col("id").cast("string")).alias("word"), F.lit(4.0).alias("zipf"))
    rows = spark.createDataFrame([(1, "дума1999999"), (2, "дума2000000")], "id long, t string")
    got = with_lexicon(rows, ["id"], lambda row, reader: str(reader.zc(row["t"])), T.StringType(), Languages(large, "bg", "en"))
    assert {r.id: r.result for r in got.collect()} == {1: "4.0", 2: "0.0"}


def test_receipt_words_that_the_lexicon_knows_stay(spark, lexicon):
    words = spark.createDataFrame([("КАРТА",), ("KAPTA",), ("цени",), ("СУМЯ",), (None,)], "w string")
    got = {r.w: r.fixed for r in receipts.fixed_words(words, "w", Languages(lexicon, "bg", "en")).collect()}
    assert got == {w: None if w is None else receipts.fix_word(w, Reader(CYR, LAT).known) for w in got}


def test_a_decision_is_made_once_for_all_rows_and_a_lexicon_is_worked_out_once(spark, lexicon, monkeypatch):
    from pagewright.functions import asking

    tables, real = [], asking.written
    monkeypatch.setattr(asking, "written", lambda df: tables.append(real(df)) or tables[-1])
    rows = spark.range(300).select("id", F.array(F.lit("тoй"), F.lit("cok"), F.lit("lake"), F.lit("stone")).alias("t"))
    got = with_lexicon(rows, ["id"], lambda row, reader: " ".join(reader.choose(t, None, "cyr") for t in row["t"]), T.StringType(), Languages(lexicon, "bg", "en"))
    whole = Reader(CYR, LAT)
    assert {r.result for r in got.collect()} == {" ".join(whole.choose(t, None, "cyr") for t in ("тoй", "cok", "lake", "stone"))}
    questions = [t for t in tables if "q" in t.columns]
    assert max(t.count() for t in questions) < 5  # words of 300 rows; stone and lake, which no other word looks like, ask nothing
    assert sum(t.columns == ["cyr", "word", "zipf"] for t in tables) == 1


def test_a_row_that_lacks_nothing_is_not_run_again(spark, lexicon):
    """Only answers that differ from those without a lexicon come back, and what is done carries no words on."""
    from pagewright.functions import asking

    rows = spark.createDataFrame([(1, "stone"), (2, "cok")], "id long, t string")
    steps = asking._by_decisions(lambda row, reader: reader.choose(row["t"], None, "cyr"))()
    first = {i: steps({"id": i, "t": t}, [], []) for i, t in ((1, "stone"), (2, "cok"))}
    assert first[1] == ("stone", []) and [x["q"] for x in first[2][1]] == ['["choose", "cok", null, "cyr"]']
    assert steps({"id": 2, "t": "cok"}, [{"q": first[2][1][0]["q"], "a": '"сок"'}], first[2][1]) == ("сок", [])
    got = with_lexicon(rows, ["id"], lambda row, reader: reader.choose(row["t"], None, "cyr"), T.StringType(), Languages(lexicon, "bg", "en"))
    assert {r.id: r.result for r in got.collect()} == {1: "stone", 2: Reader(CYR, LAT).choose("cok", None, "cyr")}
