"""Text functions: tokens, snippets, text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: Extensions and bare names of text files (fixed values).
TEXT_EXTENSIONS = """
.txt .text .log .md .markdown .mdown .mkd .rst .csv .tsv .go .py .pyw .js .mjs .cjs .ts .tsx .jsx .java .c .h .cc .cpp .cxx .hpp .hh .rs .rb .php
.swift .kt .kts .scala .sh .bash .zsh .fish .ps1 .bat .cmd .sql .html .htm .css .scss .sass .less .xml .json .jsonl .yaml .yml .toml .ini .cfg .conf .properties .proto .gradle
""".split()
TEXT_NAMES = ["dockerfile", "makefile", "rakefile", "gemfile", "procfile"]


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits; runs of CJK characters as bigrams, after all others. Null gives none.

    Text without CJK characters takes one pass of one regular expression.
    """
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    low = F.lower(text)
    split = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.regexp_extract_all(low, F.lit(f"({_CJK}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))))
    return F.when(text.isNull(), empty).when(text.rlike(_CJK), F.concat(split(F.regexp_replace(low, _CJK, " ")), pairs)).otherwise(split(low))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snippet(content: Column, status: Column, size: int = 240) -> Column:
    """First code points of the trimmed content; empty when blank, null or the file failed."""
    trimmed = F.regexp_replace(content, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when((status == "failed") | trimmed.isNull(), F.lit("")).otherwise(F.substring(trimmed, 1, size))


def looks_binary(text: Column) -> Column:
    """A NUL anywhere, or more than a tenth control characters other than tab, LF, CR, FF and BS. Empty text is text."""
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x01-\x07\x0b\x0e-\x1f]", ""))
    return text.contains("\0") | ((F.length(text) > 0) & (control * 10 > F.length(text)))


def text_file(path: Column) -> Column:
    """Whether a path's extension or bare name is that of a text file, letter case aside."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.regexp_extract(name, r"(\.[^./]+)$", 1).isin(TEXT_EXTENSIONS) | name.isin(TEXT_NAMES)


def image_format(head_hex: Column) -> Column:
    """jpeg, png or gif by the magic bytes (upper-case hex); else null."""
    return F.when(head_hex.startswith("FFD8FF"), "jpeg").when(head_hex.startswith("89504E470D0A1A0A"), "png").when(head_hex.startswith("474946383761") | head_hex.startswith("474946383961"), "gif")


def readable(data: Column) -> Column:
    """Bytes as text, in which what is no UTF-8 is U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))
