"""Writers: plain text, invisible PDF text, book text scripts, page records, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import letters as L


def lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, line): words joined by a space."""
    by = words.groupBy("doc_id", "page", "line_ix").agg(F.array_sort(F.collect_list(F.struct("word_ix", "t"))).alias("w"))
    return by.select("doc_id", "page", "line_ix", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("line"))


def joined_hyphens(c: Column) -> Column:
    """An array of lines with words that are cut at a line's end joined (a fold whose state is the lines so far)."""
    last = lambda acc: F.element_at(acc, -1)
    cut = lambda acc, x: (F.size(acc) > 0) & F.regexp(last(acc), F.lit(r"[\p{L}\p{N}_]-$")) & (F.substring(x, 1, 1) == F.lower(F.substring(x, 1, 1))) & (F.substring(x, 1, 1) != F.upper(F.substring(x, 1, 1)))

    def step(acc: Column, x: Column) -> Column:
        space = F.instr(x, " ")
        head = F.when(space > 0, F.substr(x, F.lit(1), space - 1)).otherwise(x)
        rest = F.when(space > 0, F.substr(x, space + 1)).otherwise(F.lit(""))
        whole = F.concat(F.substr(last(acc), F.lit(1), F.length(last(acc)) - 1), head)
        glued = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(whole), F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")))
        return F.when(F.coalesce(cut(acc, x), F.lit(False)), glued).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(c, F.array().cast("array<string>"), step)


def page_texts(words: DataFrame) -> DataFrame:
    """(doc_id, page, text): one line a line, words cut at line ends joined."""
    page = lines(words).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]).alias("l"))
    return page.select("doc_id", "page", F.concat(F.array_join(joined_hyphens(F.col("l")), "\n"), F.lit("\n")).alias("text"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of page texts, a form feed between pages; a document's gathering step holds one string a page."""
    by = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return by.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\f").alias("text"))


def plain_text(words: DataFrame) -> DataFrame:
    """(doc_id, text): one line a line, a form feed between pages, words cut at line ends joined."""
    return joined_pages(page_texts(words))


def counted(texts: DataFrame, pages: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """texts of the pages, as they were, and an observation that whatever job reads them fills: pages, words, and pages without text."""
    seen = Observation(name)
    n = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))
    all_pages = pages.select("doc_id", "page").join(texts, ["doc_id", "page"], "left")
    watched = all_pages.observe(seen, F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(n), F.lit(0)).alias("words"), F.count_if(n == 0).alias("empty"))
    return watched.where("text is not null"), seen


def as_lines(text: Column) -> Column:
    """A text less its last line end, which the text writer adds."""
    return F.regexp_replace(text, r"\n\z", "")


def write_text(words: DataFrame, path: str) -> None:
    plain_text(words).select(as_lines(F.col("text")).alias("text")).write.mode("overwrite").text(path)


def pdf_text(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Geometry of the invisible text of every word: pages has doc_id, page, w, h (pixels) and pw (width in points)."""
    from pyspark.sql import Window

    k = F.col("pw") / F.col("w")
    line = Window.partitionBy("doc_id", "page", "line_ix")
    out = words.join(pages.select("doc_id", "page", "w", "h", "pw"), ["doc_id", "page"])
    out = out.withColumns({"top": F.min("y0").over(line) * k, "low": F.max("y1").over(line) * k, "next_x0": F.lead("x0").over(line.orderBy("word_ix")) * k, "px": F.col("x0") * k, "own": (F.col("x1") - F.col("x0")) * k})
    size = F.greatest(F.lit(1.0), F.col("low") - F.col("top"))
    target = F.when(F.col("next_x0").isNull(), F.col("own")).otherwise(F.greatest("own", F.col("next_x0") - F.col("px")))
    text = F.when(F.col("next_x0").isNull(), F.col("t")).otherwise(F.concat("t", F.lit(" ")))
    code = F.hex(F.encode(text, "UTF-16BE"))
    natural = F.length(code) / 4 * 0.5 * size
    return out.select("doc_id", "page", "line_ix", "word_ix", size.alias("font_size"), F.col("px").alias("x"), (F.col("h") * k - F.col("low") + (F.col("low") - F.col("top")) * 0.15).alias("base"), (100 * F.greatest(target, F.lit(0.5)) / natural).alias("stretch"), F.lower(code).alias("code"))


def fit_box(pw: Column, ph: Column, bw: Column, bh: Column) -> Column:
    """struct(k, dx, dy): a page scaled to fit a box, centred."""
    k = F.least(bw / pw, bh / ph)
    return F.struct(k.alias("k"), ((bw - pw * k) / 2).alias("dx"), ((bh - ph * k) / 2).alias("dy"))


def book_script(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, script): the commands that set a page's hidden text; boxes are clamped, y runs upward."""
    inside = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), F.col(top)))
    w = words.join(pages.select("doc_id", "page", "w", "h"), ["doc_id", "page"])
    w = w.select("doc_id", "page", "w", "h", "line_ix", "word_ix", "t", inside("x0", "w").cast("int").alias("a"), (F.col("h") - inside("y1", "h")).cast("int").alias("b"), inside("x1", "w").cast("int").alias("c"), (F.col("h") - inside("y0", "h")).cast("int").alias("d"))
    one = F.concat(F.lit("(word "), F.concat_ws(" ", "a", "b", "c", "d"), F.lit(" "), L.quoted(F.col("t")), F.lit(")"))
    line = w.groupBy("doc_id", "page", "w", "h", "line_ix").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", one.alias("s")))), lambda x: x["s"]), " ").alias("s"))
    text = F.concat(F.lit(" (line "), F.concat_ws(" ", "a", "b", "c", "d", "s"), F.lit(")"))
    page = line.groupBy("doc_id", "page", "w", "h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", text.alias("s")))), lambda x: x["s"]), "\n").alias("s"))
    script = F.concat(F.lit("select "), F.col("page").cast("string"), F.lit("\nset-txt\n(page 0 0 "), F.concat_ws(" ", "w", "h"), F.lit("\n"), F.col("s"), F.lit(")\n.\n"))
    return page.select("doc_id", "page", script.alias("script"))


def page_records(words: DataFrame, pages: DataFrame) -> DataFrame:
    """The nested page record: (doc_id, page, w, h, lines: array<array<struct<t, box>>>)."""
    word = F.struct("word_ix", "t", F.array(*(F.bround(c, 0).cast("int") for c in ("x0", "y0", "x1", "y1"))).alias("box"))
    line = words.groupBy("doc_id", "page", "line_ix").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: F.struct(x["t"].alias("t"), x["box"].alias("box"))).alias("line"))
    page = line.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "line"))), lambda x: x["line"]).alias("lines"))
    return pages.select("doc_id", "page", "w", "h").join(page, ["doc_id", "page"], "left")


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def flat_words(records: DataFrame) -> DataFrame:
    """The word table of nested page records."""
    line = records.select("doc_id", "page", F.posexplode("lines").alias("line_ix", "line"))
    word = line.select("doc_id", "page", "line_ix", F.posexplode("line").alias("word_ix", "w"))
    return word.select("doc_id", "page", "line_ix", "word_ix", F.col("w.t").alias("t"), *(F.get("w.box", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))


def append_history(scores: DataFrame, path: str) -> None:
    """Appends (date, commit, version, sample, system, words, word_acc, char_acc), accuracies with four decimals."""
    four = lambda c: F.col(c).cast("decimal(10,4)")
    scores.withColumns({"word_acc": four("word_acc"), "char_acc": four("char_acc")}).write.mode("append").option("header", True).csv(path)
