"""DataFrame operators on small tables: golden cases, and the Column forms against the plain ones."""

import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import letters as L
from pagewright.functions import lexicon, locale
from pagewright.functions.asking import Languages, with_lexicon
from pagewright.functions.ocrtext import Reader, is_number, script, strip_acute
from pagewright.operators import metrics, pages, planning, spatial
from pagewright.plans import registry
from pagewright.sources import readers, sinks
from pagewright.streaming import pages as streaming

WORDS = ["cok", "Pека", "café", "ѓ", "12", "IV", "река", "a", "", "Слаvа", "ка́к", "ß", "ГОЛям", "Б", "x2", "’"]


def one(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_columns_agree_with_plain_functions(spark):
    assert one(spark, WORDS, L.script) == [script(w) for w in WORDS]
    plain = [w for w in WORDS if w != "ка́к"] + ["ка́к"]
    assert one(spark, plain, L.strip_acute) == [strip_acute(w) for w in plain]
    assert one(spark, WORDS, L.bulgarian_letters) == [pages.bulgarian_letters(w) for w in WORDS]
    kinds = [w for w in WORDS if w.isalpha() and w != "ß"]
    assert one(spark, kinds, L.case_kind) == [pages.case_kind(w) for w in kinds]


def test_lexicon_known(spark):
    lex = spark.createDataFrame([("bg", "река", 4.6), ("bg", "сок", 3.5), ("en", "lake", 5.6)], "lang string, word string, zipf double")
    words = ["река", "Река,", "lake", "§", "12.5", "xliv", "cx", "33rd", "река-lake", "", "кука", "12"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.known for r in lexicon.known(df, lex, "w", "bg", "en").collect()}
    r = Reader({"река": 4.6, "сок": 3.5}, {"lake": 5.6})
    assert got == {w: r.known(w) for w in words}
    assert r.clean("cok") == "сок"


def test_planning(spark):
    df = spark.createDataFrame([(1, "1-3,7,9-", 10), (2, None, 3), (3, "0,5,99", 6), (4, "", 0), (5, "-2", 4)], "id int, spec string, n int")
    got = {}
    for r in planning.selected_pages(df).orderBy("id", "page").collect():
        got.setdefault(r.id, []).append(r.page)
    assert got == {1: [1, 2, 3, 7, 9, 10], 2: [1, 2, 3], 3: [5], 5: [1, 2]}
    lg = [tuple(r[0]) for r in spark.createDataFrame([("bul+eng",), ("eng",), ("deu",)], "s string").select(planning.languages(F.col("s"))).collect()]
    assert lg[0] == ("bul+eng", "bg", "en", planning.MODEL_CYR) and lg[1][3] == planning.MODEL_EN and lg[2] == ("deu", None, "de", planning.MODEL_LAT)
    shapes = spark.createDataFrame([(1, 1, 400, 1200), (2, 1, 1240, 1754)], "doc_id int, page int, w int, h int")
    assert {r.doc_id: r.profile for r in planning.profile(shapes).collect()} == {1: "receipt", 2: "book"}


def test_stages_resume(spark, tmp_path):
    stages, seen = planning.Stages(spark, str(tmp_path)), []
    tasks = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, page long")

    def work(df):
        seen.append(df.count())
        return df.withColumn("x", F.col("page") * 2)

    assert stages.run("ocr", {"dpi": 300}, tasks, work).count() == 2
    assert stages.run("ocr", {"dpi": 300}, tasks.union(spark.createDataFrame([(1, 3)], tasks.schema)), work).count() == 3
    assert stages.run("ocr", {"dpi": 400}, tasks, work).count() == 2
    assert seen == [2, 1, 2]


def test_score(spark):
    df = spark.createDataFrame([(1, "Река мия ри-\nбата днес", "река мие рибата днес"), (2, "", "")], "id long, ref string, hyp string")
    s = {r.id: r for r in metrics.word_scores(df, "id").collect()}
    assert s[1].words == 4 and s[1].word_recall == 0.75 and s[2].words == 0 and s[2].word_f1 == 0
    c = df.where("id = 1").select(metrics.character_accuracy(F.col("ref"), F.col("hyp"))).first()[0]
    assert 0.9 < c < 1
    assert {r.id: r.num_recall for r in metrics.number_recall(df, "id").collect()} == {1: 1.0, 2: 1.0}
    till = spark.createDataFrame([(1, "Хляб\t1 x\t2.50\nМляко\t3.10\nтекст", "Хляб 1 2.50\nМляко 3.70"), (2, "текст", "")], "id long, ref string, hyp string")
    assert {r.id: r.row_acc for r in metrics.row_accuracy(till, "id").collect()} == {1: 0.5, 2: 0.0}


def test_spatial_against_plain_loops(spark):
    rng = random.Random(4)
    words = lambda n: [(1 + i % 3, i, float(x := rng.randint(0, 200)), float(y := rng.randint(0, 150)), x + float(rng.randint(1, 60)), y + float(rng.randint(1, 50))) for i in range(n)]
    a, b = words(90), words(80)
    kind = "page int, ix int, x0 double, y0 double, x1 double, y1 double"
    got = {r.ix: r.partner for r in spatial.best_partner(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ("page", "ix")).collect()}
    parts = {r.ix: r.parts for r in spatial.covered_words(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ("page", "ix")).collect()}
    left = {r.ix for r in spatial.uncovered(spark.createDataFrame(b, kind), spark.createDataFrame(a, kind), ("page", "ix")).collect()}
    item = lambda r: {"t": "", "box": list(r[2:]), "ix": r[1]}
    for r in a:
        others = [item(x) for x in b if x[0] == r[0]]
        best = pages.best_match(item(r), others)
        assert got[r[1]] == (best and best["ix"])
        assert parts.get(r[1], []) == [p["ix"] for p in sorted(pages.parts_inside(item(r), others), key=lambda p: (p["box"][0], p["ix"]))]
    for r in b:
        assert (r[1] in left) == (not any(pages._covers(item(r)["box"], list(x[2:])) for x in a if x[0] == r[0]))


def test_best_number_around_equals_plain_loops(spark):
    r = random.Random(8)
    texts = ["12.50", "12,50", "1250", "(12.50)", "x12.50", "7", "125O", "12.5O 12.50", "ab", "99.1"]
    make = lambda n: [(1 + k % 2, k, r.choice(texts), *(lambda x, y: (x, y, x + float(r.randrange(20, 60)), y + 20.0))(float(r.randrange(300)), float(r.choice([0, 30, 35])))) for k in range(n)]
    a, b = make(40), make(40)
    kind = "page long, ix int, t string, x0 double, y0 double, x1 double, y1 double"
    got = {x.ix: x.partner for x in spatial.best_number(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ("page", "ix")).collect()}
    want = {}
    for page, ix, t, *box in a:
        if is_number(t):
            best = pages.same_number_near({"t": t, "box": box}, [{"ix": i, "t": u, "box": list(c)} for p, i, u, *c in b if p == page], Reader({}, {}))
            want[ix] = best and best["ix"]
    assert got == want and any(v is not None for v in want.values())


def test_page_tables(spark):
    r = Languages(spark.createDataFrame([("bg", "река", 4.6)], "lang string, word string, zipf double"), "bg", "en")
    words = spark.createDataFrame([(1, 1, 0, 0, 0, "река", 90.0, 0.9, 0.0, 0.0, 40.0, 20.0), (1, 1, 0, 1, 1, "$$", 5.0, 0.9, 50.0, 0.0, 60.0, 20.0)], "doc_id long, page long, line_ix int, word_ix int, ix int, t string, conf double, score double, x0 double, y0 double, x1 double, y1 double")
    assert [x.t for x in pages.single_engine_pages(words, r).collect()] == ["река"]
    assert [x.t for x in pages.fuse_pages(words, words.where("ix = 0"), r).collect()] == ["река"]
    assert pages.fuse_pages(words.limit(0), words.limit(0), r).count() == 0
    assert [x.t for x in pages.row_pages(words).orderBy("word_ix").collect()] == ["река", "$$"]


def test_text_export(spark):
    page = [("Лич-", 0), ("ността", 1), ("е", 1), ("Б-", 2), ("Г", 3)]
    rows = [(1, p, l, i, t) for p in (1, 2) for i, (t, l) in enumerate(page)]  # noqa: E741
    text = sinks.plain_text(spark.createDataFrame(rows, "doc_id long, page int, line_ix int, word_ix int, t string")).first().text
    assert text == "\f".join(["Личността\nе\nБ-\nГ\n"] * 2)


def test_records_round_trip(spark):
    rows = [(1, 1, 0, 0, 'a"b', 0.5, 1.5, 2.5, 3.5), (1, 1, 1, 0, "c", 1.0, 2.0, 3.0, 4.0)]
    w = spark.createDataFrame(rows, "doc_id long, page int, line_ix int, word_ix int, t string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([(1, 1, 100, 50), (1, 2, 100, 50)], "doc_id long, page int, w int, h int")
    rec = sinks.page_records(w, p)
    assert {r.page: r.lines for r in rec.collect()}[2] is None
    back = sinks.flat_words(rec).orderBy("line_ix").collect()
    assert [(x.t, x.x0, x.y0) for x in back] == [('a"b', 0.0, 2.0), ("c", 1.0, 2.0)]
    script = sinks.book_script(w, p).first().script
    assert '(word 0 46 2 48 "a\\"b")' in script and script.startswith("select 1\nset-txt\n(page 0 0 100 50\n (line ")


def test_readers(spark, tmp_path):
    book = tmp_path / "book"
    book.mkdir()
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (book / "0003.tsv").write_text(head + '5\t1\t2\t1\t1\t1\t10\t20\t30\t10\t95.5\t"quoted\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t9\tfirst\n4\t1\t1\t1\t1\t1\t1\t2\t3\t4\t-1\t\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t9\t  \n')
    got = readers.tsv(spark, str(book / "*.tsv"), 2.0).orderBy("line_ix").collect()
    assert [(r.doc_id, r.page, r.line_ix, r.word_ix, r.t, r.x1) for r in got] == [("book", 3, 0, 0, "first", 8.0), ("book", 3, 1, 0, '"quoted', 80.0)]
    (book / "0007.json").write_text(json.dumps({"texts": ["ab cd", " "], "scores": [0.9, 0.5], "boxes": [[0, 0, 50, 20], [0, 0, 1, 1]]}))
    words = readers.line_to_words(readers.recognised(spark, str(book / "*.json"))).orderBy("word_ix").collect()
    assert [(r.t, r.x0, r.x1, r.y1) for r in words] == [("ab", 0.0, 20.0, 20.0), ("cd", 30.0, 50.0, 20.0)]
    (book / "p10.PNG").write_bytes(b"x")
    (book / "p2.jpg").write_bytes(b"y")
    (book / ".p1.jpg").write_bytes(b"z")
    assert [os.path.basename(r.path) for r in readers.images(spark, str(book)).orderBy("page").collect()] == ["p2.jpg", "p10.PNG"]
    (tmp_path / "sr.json").write_text(json.dumps({"Ready.": "Спремно.", "{n} page": ["{n} страна", "{n} стране", "{n} страна"]}), encoding="utf-8")
    forms = {r.key: r.forms for r in readers.catalog(spark, str(tmp_path / "sr.json")).collect()}
    assert forms["Ready."] == ["Спремно."] and len(forms["{n} page"]) == 3


def test_slanted_words_agree_with_the_plain_form(spark):
    poly = [[40.0, 917.0], [700.0, 950.0], [697.0, 1000.0], [37.0, 967.0]]
    df = spark.createDataFrame([(1, 1, 0, " ОБЩА СУМА  ЕВРО ", 0.9, [40.0, 917.0, 700.0, 1000.0], poly)], "doc_id long, page int, line_ix int, text string, score double, box array<double>, poly array<array<double>>")
    got = [[r.x0, r.y0, r.x1, r.y1] for r in readers.line_to_words(df).orderBy("word_ix").collect()]
    want = [w["box"] for w in pages.line_words(" ОБЩА СУМА  ЕВРО ", [40, 917, 700, 1000], poly)]
    assert all(math.isclose(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_external_engine_missing(spark):
    def start():
        raise ImportError("no module")

    with pytest.raises(Exception, match="not installed"):
        readers.external(spark.range(1), "id long", start, "engine").collect()


def test_locale(spark):
    n = [("ru", x, f) for x, f in zip((1, 3, 5, 11, 21, 22, 112), (0, 1, 2, 2, 0, 1, 2), strict=True)]
    n += [("sl", x, f) for x, f in zip((1, 2, 3, 5, 101), (0, 1, 2, 3, 0), strict=True)]
    n += [("ro", x, f) for x, f in zip((1, 2, 19, 20, 101), (0, 1, 1, 2, 2), strict=True)]
    n += [("lt", x, f) for x, f in zip((1, 2, 10, 11, 21), (0, 1, 2, 2, 0), strict=True)] + [("en", 1, 0), ("en", 2, 1)]
    df = spark.createDataFrame(n, "lang string, n long, form int")
    assert df.where(locale.plural() != F.col("form")).count() == 0
    names = [(["bg-BG", "en-US"], "bg"), (["ja-JP", "pl-PL"], "pl"), (["sr-Latn-RS"], "sr_Latn"), (["sr_RS@latin"], "sr_Latn"), (["sr-RS"], "sr"), (["uk_UA.UTF-8"], "uk"), (["nn-NO"], "nb"), (["ja-JP"], "en")]
    df = spark.createDataFrame(names, "p array<string>, want string")
    assert df.where(locale.negotiate(F.col("p")) != F.col("want")).count() == 0
    assert one(spark, ["fr", "de", "en"], lambda c: locale.number(F.lit(12345), c)) == ["12\u00a0345", "12.345", "12,345"]
    assert one(spark, ["Спремно.", "Љубав"], locale.serbian_latin) == ["Spremno.", "Ljubav"]


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in" / "book"
    folder.mkdir(parents=True)
    for p in (1, 2):
        (folder / f"000{p}.json").write_text(json.dumps({"texts": [f"page {p}"], "scores": [1.0], "boxes": [[0, 0, 60, 20]], "polys": None}))
    stream = streaming.recognised_stream(spark, str(tmp_path / "in"))
    for want in (4, 6):
        q = streaming.run(stream, readers.line_to_words, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == want
        (folder / "0003.json").write_text(json.dumps({"texts": ["page 3"], "scores": [1.0], "boxes": [[0, 0, 60, 20]]}))


def test_history(spark, tmp_path):
    s = spark.createDataFrame([("2026-01-01", "abc", "1", "s", "ours", 10, 0.98765, 0.5)], "date string, commit string, version string, sample string, system string, words int, word_acc double, char_acc double")
    for _ in range(2):
        sinks.append_history(s, str(tmp_path / "h"))
    got = readers.history(spark, str(tmp_path / "h")).collect()
    assert len(got) == 2 and got[0].word_acc == 0.9877


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert glob.glob(os.path.dirname(registry.__file__) + "/*.py")


def test_missing_output_ends_the_run(spark):
    tasks, done = spark.range(3).selectExpr("id as doc_id", "id as page"), spark.range(2).selectExpr("id as doc_id", "id as page")
    assert planning.required(done, tasks).count() == 2 and planning.required(tasks, tasks.union(tasks)).count() == 3
    with pytest.raises(Exception, match="no output for 2, 2"):
        planning.required(tasks, done).collect()


def test_bags_of_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", ""), (3, "a a b", "a b b")], "k int, ref string, hyp string")
    assert {r.k: (r.words, r.word_recall) for r in metrics.word_scores(df, "k").collect()} == {1: (0, 0.0), 2: (0, 0.0), 3: (3, round(2 / 3, 6))}


def test_command_line(spark, tmp_path):
    from pagewright import cli

    book = tmp_path / "in" / "book"
    book.mkdir(parents=True)
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    for page, words in ((1, ["First", "page"]), (2, ["second", "|", "page"])):
        (book / f"000{page}.tsv").write_text(head + "".join(f"5\t1\t1\t1\t1\t{k}\t{100 * k}\t10\t90\t20\t{5 if w == '|' else 90}\t{w}\n" for k, w in enumerate(words)))
    ask = lambda *more: cli.run(spark, cli.parser().parse_args([str(tmp_path / "in"), "-o", str(tmp_path / "out"), *more]))
    done = ask("--formats", "txt,djvu,json", "--text-layout", "rows", "--profile", "book")
    assert sorted((r.doc, r.page, r.t) for r in done.collect()) == [("book", 1, "First"), ("book", 1, "page"), ("book", 2, "page"), ("book", 2, "second")]
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "out/txt/doc=book/*.txt")))
    assert text == "First page\n\fsecond page\n"
    assert "select 2" in spark.read.parquet(str(tmp_path / "out/djvu")).where("page = 2").first().script and spark.read.json(str(tmp_path / "out/json")).count() == 2
    assert {r.page for r in ask("--pages", "2-").collect()} == {2}
    with pytest.raises(ValueError):
        ask("--formats", "docx")


def test_files_of_other_pages_are_not_opened(spark, tmp_path):
    assert readers.page_ranges("1-3, 7,9-,-2") == [(1, 3), (7, 7), (9, None), (1, 2)]
    for doc in ("one book", "two"):
        (tmp_path / doc).mkdir()
        for page in range(1, 13):
            (tmp_path / doc / f"{page:04}.tsv").write_text(f"level\ttext\n5\t{page}\n")
    paths = f"{tmp_path}/*/*.tsv"
    for spec, want in (("3-5", 6), ("2,11-", 6), ("", 24), ("99", 0)):
        scan = spark.read.option("sep", "\t").option("header", True).schema("level string, text string").csv(paths).where(readers.in_ranges(spec))
        assert len(scan.collect()) == want
        metrics = scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
        assert metrics.apply("numFiles").value() == want
    names = readers.page_files(spark, paths)
    assert {(r.doc_id, r.page) for r in names.collect()} == {(d, p) for d in ("one book", "two") for p in range(1, 13)}
    assert "content" not in names._jdf.queryExecution().executedPlan().collectLeaves().head().output().mkString()


def test_command_line_with_two_engines(spark, tmp_path):
    from pagewright import cli

    book = tmp_path / "in" / "книга 1"
    book.mkdir(parents=True)
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    page = lambda words: head + "".join(f"5\t1\t1\t1\t1\t{k}\t{100 * k}\t10\t90\t20\t90\t{w}\n" for k, w in enumerate(words))
    (book / "0001.tsv").write_text(page(["pека", "cok"]))
    (book / "0001.json").write_text(json.dumps({"texts": ["река сок"], "scores": [0.99], "boxes": [[0, 10, 190, 30]], "polys": None}))
    lex = str(tmp_path / "lexicon")
    spark.createDataFrame([("bg", "река", 4.6), ("bg", "сок", 3.5), ("en", "late", 5.0)], "lang string, word string, zipf double").write.parquet(lex)
    ask = lambda *more: cli.run(spark, cli.parser().parse_args([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-l", "bul+eng", "--profile", "book", "--lexicon", lex, *more]))
    assert sorted((r.doc, r.t) for r in ask().collect()) == [("книга 1", "река"), ("книга 1", "сок")]
    report: dict = {}
    (book / "0003.tsv").write_text(page([]) + page(["||"]).replace(head, "").replace("\t90\t||", "\t5\t||"))
    cli.run(spark, cli.parser().parse_args([str(tmp_path / "in"), "-o", str(tmp_path / "counted"), "--lexicon", lex, "--engine", "tesseract"]), report)
    assert report == {"pages": 2, "words": 2, "empty": 1}
    (book / "0003.tsv").write_text(head)
    stages = lambda: {f: len(glob.glob(f + "/*.parquet")) for f in glob.glob(str(tmp_path / "out/stages/words/*"))}
    before = stages()
    ask()  # finished pages are not built again
    assert stages() == before and len(before) == 1
    (book / "0002.tsv").write_text(page(["late"]))
    assert sorted(r.t for r in ask().collect()) == ["late", "река", "сок"] and set(stages()) == set(before)
    assert ask("--engine", "tesseract").count() == 3 and len(stages()) == 2
