"""Quotes found in texts, and spans widened to whole sentences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that are written in several ways, by the plain one.
BLANKS = "\u00a0\u2007\u202f\u2009"
DROPPED = "\ufeff\u00ad\u200b\u200c\u200d"
QUOTES = "\u201c\u201d\u201e\u00ab\u00bb"
APOSTROPHES = "\u2018\u2019\u201a"
DASHES = "\u2013\u2014\u2212\u2010\u2011"
FOUND = "struct<start: int, end: int, reason: string>"
LEAST = 12
#: Endings that are no ends of sentences.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "dr", "mr", "mrs", "no", "fig", "cf", "approx")
_END = re.compile(r"[.!?]+[\"')\]»”]*(?=\s|$)")


def plain(text: Column) -> Column:
    """A text in plain signs and single blanks, without signs that have no width."""
    signs = F.translate(text, QUOTES + APOSTROPHES + DASHES + DROPPED, '"' * len(QUOTES) + "'" * len(APOSTROPHES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(signs, rf"[\s{BLANKS}]+", " "))


def _pattern(words: Column) -> Column:
    """A pattern that finds plain words in a text, whichever signs and white space it is written with."""
    within = f"[{DROPPED}]*"
    escaped = F.regexp_replace(words, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1")
    spaced = F.regexp_replace(escaped, r"(\\?+[^ ])(?=.)", "$1" + within)
    spaced = F.replace(spaced, F.lit(" "), F.lit(rf"[\s{BLANKS}][\s{BLANKS}{DROPPED}]*"))
    for sign, others in (('"', QUOTES), ("'", APOSTROPHES), ("\\-", DASHES)):
        spaced = F.replace(spaced, F.lit(sign), F.lit(f"[{sign}{others}]"))
    return spaced


def aligned(text: Column, quote: Column, window: tuple[Column, Column] | None = None, least: int = LEAST) -> Column:
    """struct(start, end, reason) of a quote in a text, whatever quotation marks, dashes and white space it is written with.

    The quote becomes a pattern, so the text is searched as it is, and the offsets (in code points, end exclusive) are
    lengths of what was matched. The reason is exact, or why there is no span: too short, not found, ambiguous (found
    twice, also where the places overlap), outside the window.
    """
    words = plain(quote)
    text = F.coalesce(text, F.lit(""))

    def found(p: Column) -> Column:
        many = F.regexp_count(text, F.concat(F.lit("(?="), p, F.lit(")")))
        before = F.length(F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)"), p), F.lit(1)))
        long = F.length(F.regexp_substr(text, p))
        inside = F.lit(True) if window is None else (before >= window[0]) & (before + long <= window[1])
        span = F.struct(before.cast("int").alias("start"), (before + long).cast("int").alias("end"), F.lit("exact").alias("reason"))
        return F.when(many == 0, _unfound("not found")).when(many > 1, _unfound("ambiguous")).when(inside, span).otherwise(_unfound("outside the window"))

    # the pattern is an element of an array so that it is built once
    search = F.get(F.transform(F.array(_pattern(words)), found), F.lit(0))
    return F.when(quote.isNull() | (F.length(words) < least), _unfound("too short")).otherwise(search)


def _unfound(reason: str) -> Column:
    return F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(reason).alias("reason"))


def claim_key(predicate: Column, what: Column) -> Column:
    """A claim's plain form, by which the same claim is recognised: both parts, single blanks, lower case."""
    both = F.concat_ws(" ", F.trim(predicate), F.trim(what))
    return F.lower(F.trim(F.regexp_replace(both, rf"[\s{BLANKS}]+", " ")))


def _rows(values: list[tuple]) -> pa.Array:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("reason", pa.string())])
    return pa.array([{"start": a, "end": b, "reason": r} for a, b, r in values], kind)


def sentence_ends(text: str) -> list[int]:
    """The places after each sentence end; an abbreviation, a single letter or a number before the full stop is none."""
    ends = []
    for m in _END.finditer(text):
        word = re.search(r"[\w.]*$", text[max(0, m.start() - 12) : m.start()]).group().lower()
        if m.group().startswith(".") and len(m.group()) == 1 and (word in ABBREVIATIONS or len(word) == 1 and word.isalpha()):
            continue
        ends.append(m.end())
    return ends


def widened_span(text: str, start: int, end: int, most: int) -> tuple[int, int, str]:
    """A span grown to whole sentences within its paragraph, unless that has over `most` characters."""
    left = text.rfind("\n\n", 0, start)
    left = 0 if left < 0 else left + 2
    right = text.find("\n\n", end)
    right = len(text) if right < 0 else right
    block = text[left:right]
    ends = [left + e for e in sentence_ends(block)]
    a = max((e for e in ends if e <= start), default=left)
    b = min((e for e in ends if e >= end), default=right)
    while a < start and text[a].isspace():
        a += 1
    while b > end and text[b - 1].isspace():
        b -= 1
    return (start, end, "too long") if b - a > most else (a, b, "widened" if (a, b) != (start, end) else "whole")


def widened(text: Column, start: Column, end: Column, most: int = 2000) -> Column:
    """struct(start, end, reason) of a span of each text, grown to whole sentences."""

    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
        return _rows([(None, None, "no span") if t is None or a is None or b is None or not 0 <= a <= b <= len(t) else widened_span(t, a, b, most) for t, a, b in rows])

    return F.arrow_udf(run, FOUND)(text, start, end)
