"""Canonical text, chunks, sentences and measures of texts."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space other than line ends and the blank, for Java's and RE2's patterns.
_OTHER = r"\t\x0B\x0C\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = f"[ {_OTHER}]+"
#: The runs of it that are not one blank already, so that most of a text is copied as it is.
_UNEVEN = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"
CHUNK, WINDOWS, WINDOW_CHARS = 4000, 16, 120
_LAST_BREAK = re.compile(r"(?s).*[ \n]")
_CHUNKS = "array<struct<char_start: int, char_end: int, text: string>>"


def nfc(text: Column) -> Column:
    """Unicode's composed form. Spark has no built-in for it, but a text without characters from U+0300 on is composed already; only others go to a Python worker."""
    composed = F.arrow_udf(lambda values: pa.array([v and unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string()), "string")
    return F.coalesce(composed(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def canonical(text: Column) -> Column:
    """NFC, one kind of line end, white space inside lines as one blank, no more than two empty lines in a row, trimmed."""
    out = F.regexp_replace(F.regexp_replace(nfc(text), r"\x00", "�"), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, _UNEVEN, " "), " \n ?|\n ", "\n")
    return F.trim(F.regexp_replace(out, "\n{4,}", "\n\n\n"), F.lit(" \n"))


def chunks(text: Column, most: int = CHUNK) -> Column:
    """Consecutive pieces of a text that together are the text: up to `most` characters, cut after the last blank or line end of their second half."""

    def cut(text: str | None) -> list[dict]:
        out, start = [], 0
        while text and start < len(text):
            end = min(len(text), start + most)
            if end < len(text) and (found := _LAST_BREAK.match(text, start + most // 2, end)):
                end = found.end()
            out.append({"char_start": start, "char_end": end, "text": text[start:end]})
            start = end
        return out

    kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("text", pa.string())]))
    return F.arrow_udf(lambda texts: pa.array([cut(t) for t in texts.to_pylist()], kind), _CHUNKS)(text)


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def relevant_sentences(text: Column, terms: list[str], most: int = 5) -> Column:
    """The sentences with the most occurrences of the terms, the earlier of equals first, as one text; without any, the first sentences."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    score = lambda s: sum((occurrences(F.lower(s), t) for t in terms), F.lit(0))
    ranked = F.array_sort(F.transform(parts, lambda s, k: F.struct((-score(s)).alias("less"), k.alias("k"), s.alias("s"))))
    some = F.filter(ranked, lambda x: x["less"] < 0)
    best = F.slice(F.when(F.size(some) > 0, some).otherwise(ranked), 1, most)
    return F.array_join(F.transform(best, lambda x: x["s"]), " ")


def number_runs(text: Column) -> Column:
    return F.size(F.split(text, "[^0-9]+")) - 1


def window_signature(text: Column, windows: int = WINDOWS, chars: int = WINDOW_CHARS) -> Column:
    """Digests of windows spread evenly over the text."""
    room = F.greatest(F.length(text) - chars, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda n: F.md5(F.substr(text, 1 + F.floor(n * room / windows).cast("int"), F.lit(chars))))


def letters(text: Column, ranges: str) -> Column:
    """How many characters of the ranges the text has."""
    return F.length(F.regexp_replace(text, f"[^{ranges}]", ""))


def label(text: Column, most: int = 120) -> Column:
    """The text, or its beginning with an ellipsis where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def numbers(text: Column) -> Column:
    """The numbers written in a text, with their separators, in order of their characters, repeats included."""
    return F.array_sort(F.regexp_extract_all(text, F.lit("[0-9]+(?:[.,][0-9]+)*"), F.lit(0)))


def cut_at_word(text: Column, most: int) -> Column:
    """The text, or its whole words that fit into so many characters with an ellipsis (the bare cut where the first word is longer)."""
    start = F.left(text, F.lit(most - 1))
    whole = F.rtrim(F.regexp_replace(start, r" [^ ]*$", ""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(whole, F.lit("…")))


def one_paragraph(text: Column, most: int) -> Column:
    bare = F.trim(text)
    return ~bare.contains("\n\n") & F.length(bare).between(1, most)


def first_sentence(text: Column) -> Column:
    """The text up to its first sentence end that white space follows; empty without one."""
    return F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1)


def block(text: Column, labels: list[str], ends: list[str]) -> Column:
    """What follows the first of the labels (with a colon, at a line's start) up to a line that begins with one of the ends; null if there is none or it is blank."""
    either = lambda names: "|".join(rf"\Q{n}\E" for n in names)
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)[ \t]*(?:{either(labels)})[ \t]*:(.*?)(?=\n[ \t]*(?:{either(ends)})[ \t]*:|\z)", 1)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+\z", ""), F.lit(""))


def counter(text: Column, label: str) -> Column:
    """The first number after a label, blanks within it taken out, or null."""
    found = F.regexp_extract(text, rf"(?i)\Q{label}\E[ \t]*:?[ \t]*([0-9]+(?:[ \x{{A0}}][0-9]{{3}})*)", 1)
    return F.regexp_replace(found, r"[ \x{A0}]", "").try_cast("long")


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic form of a noun after a number: one (1, 21), few (2-4, 22-24) or many (0, 5-20, 25)."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def word_shingles(words: Column, width: int) -> Column:
    """The distinct runs of so many words, joined by blanks; none of fewer words. Give it a column, not an expression."""
    last = F.size(words) - (width - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(words, k, F.lit(width)), " ")))).otherwise(F.array().cast("array<string>"))
