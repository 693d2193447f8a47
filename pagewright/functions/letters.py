"""Scalar functions on words as Column expressions: scripts, look-alikes, marks, case, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters, Latin to Cyrillic and Cyrillic to Latin.
L2C = ("aeopcxykAEOPCXYKBHMTrun", "аеорсхукАЕОРСХУКВНМТгип")
C2L = ("аеорсхукіјѕАЕОРСХУКВНМТІЈЅ", "aeopcxykijsAEOPCXYKBHMTIJS")
# Upper-case look-alikes on receipts that the first pair leaves.
FOLD_MORE = ("36UNW", "ЗБИПШ")
# Character classes as the survey gives them.
CYR, LAT = "[Ѐ-ӿ]", "[A-Za-z]"
WORD_CHAR, LETTER, DIGIT = r"[\p{L}\p{N}_]", r"[\p{L}\p{Nl}\p{No}]", r"\p{Nd}"
# A number as printed, a price, the marks stripped before a dictionary look-up.
NUMBER = r"^\(?[\d.,:/%+-]*\d[\d.,:/%+-]*\)?$"
PRICE = r"^-?\d+[.,]\d{2}$"
CORE_MARKS = ".,;:!?\"'“”„«»()[]{}…–—-/*"
ROMAN = (r"^[ivxlc]+$", r"^(x{0,3}|xl|l?x{0,3}|xc)(i{0,3}|iv|v?i{0,3}|ix)$")


def without_marks(marks: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to, rest): translate arguments that drop combining marks from composed letters and by themselves.

    rest holds the letters that become more than one character.
    """
    source, target, rest = [], [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code < 0xE000 or ch in marks:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if any(m in parts for m in marks):
            plain = unicodedata.normalize("NFC", "".join(c for c in parts if c not in marks))
            if len(plain) == 1:
                source.append(ch)
                target.append(plain)
            else:
                rest.append((ch, plain))
    return "".join(source) + marks, "".join(target), rest


ACUTE, STRESS = without_marks("́"), without_marks("́̀")
ALL_MARKS = without_marks("".join(chr(c) for c in range(0x300, 0x370)))


def strip_acute(c: Column) -> Column:
    """Drop acute accents, of composed letters too (NFC input)."""
    for ch, plain in ACUTE[2]:
        c = F.replace(c, F.lit(ch), F.lit(plain))
    return F.translate(c, *ACUTE[:2])


def sql_without(c: str, table: tuple[str, str, list[tuple[str, str]]]) -> str:
    """The same in SQL."""
    for ch, plain in table[2]:
        c = f"replace({c}, '{ch}', '{plain}')"
    return f"translate({c}, '{table[0]}', '{table[1]}')"


def count_of(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern.replace("[", "[^", 1), ""))


def script(c: Column) -> Column:
    """cyr, lat, mix (as many of either) or none, by the number of letters."""
    n, m = count_of(c, CYR), count_of(c, LAT)
    return F.when(n > m, "cyr").when(m > n, "lat").when(n == 0, "none").otherwise("mix")


def sql_script(c: str) -> str:
    n, m = f"length(regexp_replace({c}, '[^Ѐ-ӿ]', '', 'g'))", f"length(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"
    return f"CASE WHEN {n} > {m} THEN 'cyr' WHEN {m} > {n} THEN 'lat' WHEN {n} = 0 THEN 'none' ELSE 'mix' END"


def has_letters(c: Column) -> Column:
    return F.regexp(c, F.lit("[Ѐ-ӿA-Za-z]"))


def is_number(c: Column) -> Column:
    return ~has_letters(c) & F.regexp(c, F.lit(DIGIT))


def is_full_number(c: Column) -> Column:
    return F.regexp(c, F.lit(NUMBER))


def to_cyrillic(c: Column) -> Column:
    return F.translate(c, *L2C)


def to_latin_twins(c: Column) -> Column:
    return F.translate(c, *C2L)


def fold(c: Column) -> Column:
    """The spelling in which receipt terms are compared."""
    return F.translate(F.upper(F.translate(c, *L2C)), *FOLD_MORE)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{Nl}\p{No}]", "")


def case_kind(c: Column) -> Column:
    """lower, upper, title or mixed; one upper-case letter is a title."""
    low, up = c == F.lower(c), c == F.upper(c)
    first, rest = F.substring(c, 1, 1), F.substr(c, F.lit(2))
    lower_rest = (rest == F.lower(rest)) & (rest != F.upper(rest))
    return F.when(low & ~up, "lower").when(up & ~low, F.when(F.length(c) > 1, "upper").otherwise("title")).when((first == F.upper(first)) & (first != F.lower(first)) & lower_rest, "title").otherwise("mixed")


def cased(c: Column, kind: Column) -> Column:
    title = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.when(kind == "lower", F.lower(c)).when(kind == "upper", F.upper(c)).when(kind == "title", title)


def bulgarian_letters(c: Column) -> Column:
    """Spelling that Bulgarian rules out, put right in words with a Cyrillic letter."""
    fixed = F.regexp_replace(F.regexp_replace(c, "ь(?![оО])", "ъ"), "Ь(?![оО])", "Ъ")
    fixed = F.translate(fixed, "ыЫ", "ъЪ")
    fixed = F.when(script(fixed).isin("cyr", "mix"), F.translate(fixed, "vV", "вВ")).otherwise(fixed)
    return F.when(F.regexp(c, F.lit(CYR)), fixed).otherwise(c)


def name_key(c: Column) -> Column:
    """A key that sorts names without regard to case and combining marks."""
    for ch, base in ALL_MARKS[2]:
        c = F.replace(c, F.lit(ch), F.lit(base))
    return F.replace(F.lower(F.translate(c, *ALL_MARKS[:2])), F.lit("ß"), F.lit("ss"))


# Patterns of word and number tokens and of joined line ends, as the survey gives them.
def words(c: Column, lower: bool = True) -> Column:
    """Word tokens of a text: stress marks dropped, hyphenated line ends joined, ё as е."""
    plain = c
    for ch, base in STRESS[2]:
        plain = F.replace(plain, F.lit(ch), F.lit(base))
    # Marks are outside ASCII; most texts need no look at each of their characters.
    c = F.when(F.regexp(c, F.lit(r"[^\x00-\x7F]")), F.translate(plain, *STRESS[:2])).otherwise(c)
    c = F.regexp_replace(c, r"[¬­-]\s*\n\s*(?=[\p{L}\p{Nl}\p{No}])", "")
    c = F.translate(c, "ёЁ", "еЕ")
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)"), 1)


def sql_words(c: str) -> str:
    c = sql_without(c, STRESS)
    c = rf"regexp_replace({c}, '[¬\x{{AD}}-]\s*\n\s*([\p{{L}}\p{{Nl}}\p{{No}}])', '\1', 'g')"
    return rf"regexp_extract_all(lower(translate({c}, 'ёЁ', 'еЕ')), '[\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}+')"


def numbers(c: Column) -> Column:
    """Numbers as printed, without marks at their end."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\p{Nd}[\p{Nd}.,:/%-]*)"), 1), lambda n: F.rtrim(n, F.lit(".,:")))


def sql_numbers(c: str) -> str:
    return rf"list_transform(regexp_extract_all({c}, '\p{{Nd}}[\p{{Nd}}.,:/%-]*'), lambda n: rtrim(n, '.,:'))"


def natural_key(c: Column, width: int = 20) -> Column:
    """A key whose binary order is the natural one: lower case, digit runs padded."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(F.regexp(p, F.lit(r"^\d")), F.lpad(F.ltrim(p, F.lit("0")), width, "0")).otherwise(p)), "")


def format_time(c: Column) -> Column:
    """Seconds as 1h05m or 3m07s."""
    s = c.cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h"), F.lpad(m.cast("string"), 2, "0"), F.lit("m"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s")))


def quoted(c: Column) -> Column:
    """A string of an s-expression."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def major_version(c: Column) -> Column:
    """The major version in a recogniser's version text; null if there is none."""
    found = F.regexp_extract(c, r"tesseract v?(\d+)\.", 1)
    return F.when(found != "", found.cast("int"))
