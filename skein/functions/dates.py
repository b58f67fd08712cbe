"""Dates as sources give them, with their precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names; a name may be cut to three letters, and September to four.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: What stands for a part that is not known.
UNKNOWN = ("??", "xx")


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none such."""
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def published(raw: Column) -> Column:
    """struct(date, precision) of a source's date: a day, a month or year (its first day), or none.

    A date is written as a month's name with day and year, or as parts between hyphens, of which the later ones may be
    unknown; after a whole day a time may follow. The parts are split off once, and the known ones say how precise it is.
    """
    text = F.trim(raw)
    parts = F.split(text, "-", 3)
    part = lambda k: F.try_element_at(parts, F.lit(k))
    year, month, rest = part(1), part(2), F.lower(part(3))
    digits = lambda x, n: F.length(F.coalesce(x, F.lit(""))).eqNullSafe(n) & F.translate(x, "0123456789", "").eqNullSafe("")
    day = F.left(rest, F.lit(2))
    timed = F.length(rest).eqNullSafe(2) | F.substring(rest, 3, 1).isin("t", " ")
    open_day = rest.isNull() | rest.isin(*UNKNOWN) | digits(rest, 4)
    open_month = month.isNull() | (month == "??") & F.coalesce(rest == "??", F.lit(True))
    names = F.array(*[F.lit(x) for m in MONTHS for x in (m, m[:3], m[:4] if m == "september" else m)])
    words = F.split(F.lower(text), r"\s+|,\s*")
    named = F.floor((F.nullif(F.array_position(names, words[0]), F.lit(0)) - 1) / 3) + 1
    spelt = text.rlike(r"^[A-Za-z]+\s+[0-9]{1,2},\s*[0-9]{4}$") & named.isNotNull()
    found = lambda d, precision: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(precision).alias("precision")))
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit("none").alias("precision"))
    first = F.lit("01")
    return F.coalesce(
        F.when(spelt, found(_date(words[2], named.cast("string"), words[1]), "day"))
        .when(digits(year, 4) & digits(month, 2) & digits(day, 2) & timed, found(_date(year, month, day), "day"))
        .when(digits(year, 4) & digits(month, 2) & open_day, found(_date(year, month, first), "month"))
        .when(digits(year, 4) & open_month, found(_date(year, first, first), "year")),
        none,
    )


def valid_until(dated: Column, kind: Column, days: dict[str, int]) -> Column:
    """The last day on which a fact of a kind holds, counted from its own date; null for a kind without a term."""
    terms = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    return F.date_add(F.to_date(dated), F.element_at(terms, kind))


def label(day: Column, months: list[str]) -> Column:
    """A day as `3 May 1998`, with names of the months in the order of the year; null without a day."""
    return F.concat(F.day(day).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in months]), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def after(day: Column, days: Column) -> Column:
    """The day so many days later, counted as whole years of 365 days, whole months of 30, and single days."""
    left = days % 365
    return (day + F.make_interval((days / 365).cast("int"), (left / 30).cast("int"), F.lit(0), (left % 30).cast("int"))).cast("date")
