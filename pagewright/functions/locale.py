"""Interface-language functions as Column expressions: plural forms, numbers, transliteration, negotiation, look-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages with a catalog; other names for some of them.
CODES = ("be", "bg", "bs", "ca", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "hr", "hu", "it", "lt", "lv", "mk", "nb", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sr", "sr_Latn", "sv", "uk")
ALIASES = {"no": "nb", "nn": "nb"}
# Languages that write a dot between thousands (English writes a comma, others a no-break space).
DOT = ("de", "nl", "da", "es", "it", "pt", "ro", "el", "ca", "hr", "bs", "sr", "sr_Latn", "sl", "mk")
# Serbian Cyrillic letters that become one Latin letter, and those that become two.
SERBIAN = ("абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ", "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ")
SERBIAN_PAIRS = (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž"))

#: Index of the plural form of n, by group of languages, in SQL that Spark and DuckDB share.
EAST = "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END"
PLURALS = {
    ("ru", "uk", "be", "sr", "sr_Latn", "hr", "bs"): EAST,
    ("fr", "pt"): "CASE WHEN n IN (0, 1) THEN 0 ELSE 1 END",
    ("ro",): "CASE WHEN n = 1 THEN 0 WHEN n = 0 OR n % 100 BETWEEN 2 AND 19 THEN 1 ELSE 2 END",
    ("lt",): "CASE WHEN n % 100 BETWEEN 11 AND 19 THEN 2 WHEN n % 10 = 1 THEN 0 WHEN n % 10 >= 2 THEN 1 ELSE 2 END",
    ("lv",): "CASE WHEN n % 10 = 0 OR n % 100 BETWEEN 11 AND 19 THEN 0 WHEN n % 10 = 1 THEN 1 ELSE 2 END",
    ("mk",): "CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 0 ELSE 1 END",
    ("pl",): "CASE WHEN n = 1 THEN 0 WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 1 ELSE 2 END",
    ("cs", "sk"): "CASE WHEN n = 1 THEN 0 WHEN n BETWEEN 2 AND 4 THEN 1 ELSE 2 END",
    ("sl",): "CASE n % 100 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END",
}


def plural_sql(lang: str = "lang") -> str:
    """SQL for the plural form's index, of columns lang and n."""
    cases = " ".join(f"WHEN {lang} IN ({', '.join(repr(c) for c in codes)}) THEN {rule}" for codes, rule in PLURALS.items())
    return f"CASE {cases} WHEN n = 1 THEN 0 ELSE 1 END"


def plural(lang: str = "lang", n: str = "n") -> Column:
    import re

    return F.expr(re.sub(r"\bn\b", n, plural_sql(lang)))


def number(n: Column, lang: Column) -> Column:
    s = F.format_number(n, 0)
    mark = F.when(lang == "en", ",").when(lang.isin(*DOT), ".").otherwise(" ")
    return F.replace(s, F.lit(","), mark)


def serbian_latin(c: Column) -> Column:
    for a, b in SERBIAN_PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, *SERBIAN)


def negotiate(preferred: Column) -> Column:
    """The first supported language among locale names ('sr_RS@latin', 'pl_PL.UTF-8'), else en."""

    def one(name: Column) -> Column:
        name = F.split_part(F.replace(name, F.lit("-"), F.lit("_")), F.lit("."), F.lit(1))
        parts = F.split(F.split_part(name, F.lit("@"), F.lit(1)), "_")
        base = F.lower(parts[0])
        for a, b in ALIASES.items():
            base = F.when(base == a, b).otherwise(base)
        serbian = F.when(F.array_contains(parts, "Latn") | name.endswith("@latin"), "sr_Latn").otherwise("sr")
        return F.when(base == "sr", serbian).when(base.isin(*(c for c in CODES if c not in ("sr", "sr_Latn"))), base)

    return F.coalesce(F.get(F.filter(F.transform(preferred, one), lambda x: x.isNotNull()), F.lit(0)), F.lit("en"))


def chosen(code: Column) -> Column:
    """The interface language: the code, if there is a catalog for it, else en."""
    return F.when(code.isin(*CODES), code).otherwise(F.lit("en"))


def translate_text(catalog: Column, text: Column) -> Column:
    """catalog: map of a text to its forms; the last form, or the text itself."""
    return F.coalesce(F.element_at(F.try_element_at(catalog, text), -1), text)


def translate_count(catalog: Column, singular: Column, plural_text: Column, n: Column, index: Column, shown: Column) -> Column:
    """The form of the right number with {n} filled in; forms is null where the catalog lacks the text."""
    form = F.get(F.try_element_at(catalog, singular), index)
    return F.replace(F.coalesce(form, F.when(n == 1, singular).otherwise(plural_text)), F.lit("{n}"), shown)
