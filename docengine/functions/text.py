"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Presentation ligatures and their letters. Search and comparison differ in U+FB05.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SEARCH_LIGATURES = LIGATURES | {"ﬅ": "ft"}
#: Combining ranges dropped by search.
COMBINING = "[\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe20-\\ufe2f]"
#: Byte order mark and directional controls.
INVISIBLE = "﻿‎‏‪‫‬‭‮⁦⁧⁨⁩"
#: Fixed value: scripts written from right to left.
RTL = "[\\u0590-\\u08ff\\ufb1d-\\ufdff\\ufe70-\\ufeff]"
#: Fixed value: the white space of Unicode, as a character class of both Java's and DuckDB's patterns.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same, character by character.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space with a line end in it, whole. Only the first character of white space looks ahead for one.
_WITHIN = SPACE.replace(r"\t-\r", r"\t\x0b-\r")
LINE_ENDS = rf"(?:[{_WITHIN}](?<![{SPACE}][{SPACE}])[{_WITHIN}]*+)?\n[{SPACE}]*+"
#: Fixed value: characters beyond which texts are cut before comparison.
COMPARE_CAP = 32768


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def escape_html(text: Column) -> Column:
    return replace_all(text, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


def unescape_basic(text: Column) -> Column:
    return replace_all(text, {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"})


def _nfkd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def fold_for_search(text: Column) -> Column:
    """Without soft hyphens, ligatures spelt out, lower case, decomposed for compatibility (NFKD), accents dropped."""
    fold = F.pandas_udf(_nfkd, "string", F.PandasUDFType.SCALAR_ITER)
    return F.regexp_replace(fold(F.lower(replace_all(text, {"\u00ad": ""} | SEARCH_LIGATURES))), COMBINING, "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(SPACES))


def has_text(text: Column) -> Column:
    """Whether anything but white space is there."""
    return text.rlike(f"[^{SPACE}]")


def normalize_for_compare(text: Column) -> Column:
    """Line ends unified, line breaks after a hyphen between letters or digits joined, invisible marks and soft hyphens dropped,
    ligatures spelt out, white space of any kind collapsed and stripped."""
    out = replace_all(text, {"\r\n": "\n", "\r": "\n"})
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N}])-\n(?=[\p{L}\p{N}])", "")
    out = replace_all(F.translate(out, INVISIBLE + "\u00ad", ""), LIGATURES)
    return F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))


def match_count(text: Column, needle: str) -> Column:
    """Non-overlapping, case-insensitive; an empty needle never matches."""
    if not needle:
        return F.lit(0).cast("long")
    low = F.lower(text)
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length over at most COMPARE_CAP characters; 1 for two empty texts."""
    a, b = F.left(a, F.lit(COMPARE_CAP)), F.left(b, F.lit(COMPARE_CAP))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.round(1 - F.levenshtein(a, b) / longer, 4))


def rtl_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(RTL)) / F.length(text)).otherwise(0.0)


def csv_field(value: Column) -> Column:
    """Quoted where a comma, a quote, a line break or outer white space asks for it."""
    value = F.coalesce(value, F.lit(""))
    risky = value.rlike('[,"\\n\\r]') | value.rlike(f"^[{SPACE}]|[{SPACE}]$")
    return F.when(risky, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def parse_csv(text: Column) -> Column:
    """The rows of a CSV text, each an array of fields; blank lines are none.

    Quotes may begin anywhere in a field and end with the line at the latest; two of them inside quotes stand for one.
    """
    rows = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1), has_text)

    def fields(line: Column) -> Column:
        unclosed = F.regexp_count(line, F.lit('"')) % 2 == 1
        closed = F.concat(line, F.when(unclosed, '"').otherwise(""), F.lit(","))
        raw = F.regexp_extract_all(closed, F.lit('((?:[^",]++|"[^"]*+(?:""[^"]*+)*+")*+),'), F.lit(1))
        return F.transform(raw, lambda x: F.replace(F.regexp_replace(x, '"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"')))

    return F.transform(rows, fields)


def page_separator(number: Column, total: Column) -> Column:
    return F.concat(F.lit("--- page "), number.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" ---"))


def padded(number: Column, digits: int) -> Column:
    """Zero-padded; wider numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def heading_level(text: Column, size: Column, body: Column) -> Column:
    """1 to 3 by the size over the body's, 0 for body text: long lines and lines ending like sentences are no headings."""
    plain = (F.length(text) > 120) | F.trim(text).rlike("[.,;:]$") | (F.trim(text) == "")
    ratio = size / body
    return F.when(plain, 0).when(ratio >= 1.35, 1).when(ratio >= 1.18, 2).when(ratio >= 1.06, 3).otherwise(0)


def roman(value: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999; null beyond."""
    digits = {1000: "M", 100: "CDM", 10: "XLC", 1: "IVX"}

    def place(unit: int) -> Column:
        d = (F.floor(value / unit) % 10).cast("int")
        if unit == 1000:
            return F.repeat(F.lit("M"), d)
        one, five, ten = digits[unit]
        return F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), d + 1)

    return F.when(value.between(1, 3999), F.concat(*[place(u) for u in digits]))


def alphabetic(value: Column) -> Column:
    """Bijective base 26: 1 is A, 26 is Z, 27 is AA; null below 1."""
    start = F.struct(value.cast("long").alias("n"), F.lit("").alias("text"))

    def step(s: Column, _: Column) -> Column:
        letter = F.char(F.lit(65) + F.pmod(s["n"] - 1, F.lit(26)))
        more = F.struct(F.call_function("div", s["n"] - 1, F.lit(26)).alias("n"), F.concat(letter, s["text"]).alias("text"))
        return F.when(s["n"] >= 1, more).otherwise(s)

    # fourteen letters count beyond any long
    return F.when(value >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["text"]))


def list_marker(line: Column) -> Column:
    """'bullet', 'ordered' or null."""
    return F.when(line.rlike("^ *[-*+] "), "bullet").when(line.rlike("^ *[0-9]+[.)] "), "ordered")


def is_rule(line: Column) -> Column:
    return F.trim(line).rlike("^(?:(?:- *){3,}|(?:[*] *){3,}|(?:_ *){3,})$")


def source_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("flat")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x20-\\x7e]", "?")
