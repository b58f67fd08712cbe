"""Titles, dates and numbers as pages and prose give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.articles import let


def _attribute(html: Column, key: str, name: str) -> Column:
    """The content of the first <meta> with such an attribute."""
    return F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<meta[^>]*\b{key}\s*=\s*[\"']{name}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)", 1)), F.lit(""))


def title(html: Column) -> Column:
    """struct(title, source): the first of the shared title, the heading and the document's title that isn't empty."""
    clean = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    found = [
        ("og", _attribute(html, "property", "og:title")),
        ("h1", clean(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))),
        ("title", clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))),
    ]
    return F.coalesce(*[F.when(x.isNotNull(), F.struct(x.alias("title"), F.lit(n).alias("source"))) for n, x in found])


# Where a page's date stands, how sure it is there, in order; months; how far a unit is.
DATE_PLACES = (("property", "article:published_time", 0.95), ("property", "og:published_time", 0.9), ("name", "date", 0.82), ("name", "publish-date", 0.82), ("name", "pubdate", 0.82), ("itemprop", "datePublished", 0.9))
LINKED_DATES, LINKED, TIME, HEADER, LEAD, ANYWHERE = ("datePublished", "dateCreated", "uploadDate"), 0.93, 0.75, 0.78, 0.72, 0.62
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
SURE, KNOWN, HEAD, LEADING = 0.7, 0.45, 1200, 2000
_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: A date in prose: by numbers, or with a month's name before or after the day.
IN_PROSE = rf"(?i)\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{_MONTH}\.? [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_MONTH}\.?,? [0-9]{{4}})(?![0-9])"


def flexible_time(raw: Column, as_of: Column) -> Column:
    """The time that a date as feeds and searches give it means, in UTC: ISO, partly unknown (2024-??-??), `3 weeks ago`, e-mail style, or a month's name with day and year; null if it is none of these.

    Months are 30 days and years 365 in relative dates, which count from as_of.
    """
    return let(F.trim(raw), lambda text: _time(text, as_of))


def _time(text: Column, as_of: Column) -> Column:
    part = lambda pattern, group: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    unknown = F.when(text.rlike(r"^[0-9]{4}-([0-9]{2}|\?\?)-([0-9]{2}|\?\?)$"), F.replace(text, F.lit("??"), F.lit("01")))
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.regexp_replace(text, "[zZ]$", "+00:00"))
    ago = r"(?i)^([0-9]{1,4})\s+(day|week|month|year)s?\s+ago$"
    days = part(ago, 1).cast("int") * F.coalesce(*[F.when(F.lower(part(ago, 2)) == u, F.lit(n)) for u, n in UNITS.items()])
    relative = F.timestamp_seconds(F.unix_seconds(as_of.cast("timestamp")) - days.cast("long") * 86_400)
    number = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3)))).cast("string"), 2, "0")
    mail = rf"(?i)^(?:[a-z]{{3}}, )?([0-9]{{1,2}}) ({_MONTH}) ([0-9]{{4}}) ([0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?)(?: ?(?:([+-][0-9]{{2}}):?([0-9]{{2}})|GMT|UTC|Z))?$"
    mailed = F.concat(part(mail, 3), F.lit("-"), number(part(mail, 2)), F.lit("-"), F.lpad(part(mail, 1), 2, "0"), F.lit("T"), F.left(F.concat(part(mail, 4), F.lit(":00")), F.lit(8)), F.coalesce(F.concat(part(mail, 5), F.lit(":"), part(mail, 6)), F.lit("+00:00")))
    front = rf"(?i)^(?:[a-z]+, )?({_MONTH})\.? ([0-9]{{1,2}}), ([0-9]{{4}})$"
    back = rf"(?i)^([0-9]{{1,2}}) ({_MONTH})\.?,? ([0-9]{{4}})$"
    named = lambda pattern, day, month: F.concat(part(pattern, 3), F.lit("-"), number(part(pattern, month)), F.lit("-"), F.lpad(part(pattern, day), 2, "0"))
    return F.coalesce(unknown.try_cast("timestamp"), iso.try_cast("timestamp"), relative, mailed.try_cast("timestamp"), named(front, 2, 1).try_cast("timestamp"), named(back, 1, 2).try_cast("timestamp"))


def publication_date(html: Column) -> Column:
    """struct(date, source, confidence) of the first place of a page, in the order of DATE_PLACES and then of its text, that holds a date."""
    epoch = F.lit("1970-01-01")
    day = lambda raw: F.to_date(F.when(~F.coalesce(raw, F.lit("")).contains("ago"), flexible_time(raw, epoch)))
    shown = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|\s+", " "))
    header = F.regexp_extract(html, rf"(?is)<h1\b(.{{0,{HEAD}}})", 1)
    in_prose = lambda text: F.nullif(F.regexp_extract(text, IN_PROSE, 1), F.lit(""))
    linked = F.coalesce(*[F.nullif(F.regexp_extract(html, rf'"{name}"\s*:\s*"([^"]+)"', 1), F.lit("")) for name in LINKED_DATES])
    found = [(f"{name}", sure, _attribute(html, key, name)) for key, name, sure in DATE_PLACES]
    found += [
        ("time", TIME, F.nullif(F.regexp_extract(html, r"(?i)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)", 1), F.lit(""))),
        ("linked data", LINKED, linked),
        ("header", HEADER, in_prose(F.regexp_replace(header, r"(?s)<[^>]*>", " "))),
        ("lead", LEAD, let(shown, lambda x: in_prose(F.left(F.regexp_replace(x, " +", " "), F.lit(LEADING))))),
        ("text", ANYWHERE, let(shown, in_prose)),
    ]
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit("none").alias("source"), F.lit(0.0).alias("confidence"))
    places = F.array(*[F.struct(x.alias("raw"), F.lit(n).alias("source"), F.lit(c).alias("confidence")) for n, c, x in found])
    read = F.transform(places, lambda x: F.struct(day(x["raw"]).alias("date"), x["source"].alias("source"), x["confidence"].alias("confidence")))
    return F.coalesce(F.get(F.filter(read, lambda x: x["date"].isNotNull()), F.lit(0)), none)


def settled(page: Column, registered: Column) -> Column:
    """struct(date, source, confidence, status): a page's date, else the registry's with little confidence; resolved, low confidence or unresolved."""
    date = F.coalesce(page["date"], registered)
    sure = F.when(page["date"].isNotNull(), page["confidence"]).when(registered.isNotNull(), KNOWN).otherwise(0.0)
    source = F.when(page["date"].isNotNull(), page["source"]).when(registered.isNotNull(), "registry").otherwise("none")
    status = F.when(date.isNull(), "unresolved").when(sure >= SURE, "resolved").otherwise("low confidence")
    return F.struct(date.alias("date"), source.alias("source"), sure.alias("confidence"), status.alias("status"))


def shown_date(issue: Column, material: Column, found: Column) -> Column:
    """struct(date, source, shown, kind): the date that an issue gives, else the material's; what is shown without one is the day when it was found."""
    def shown(days: Column) -> Column:
        date = F.coalesce(days["issue"], days["material"])
        source = F.when(days["issue"].isNotNull(), "issue").when(days["material"].isNotNull(), "material").when(issue.isNotNull(), "issue").when(material.isNotNull(), "material").otherwise("none")
        return F.struct(date.alias("date"), source.alias("source"), F.coalesce(date, F.to_date(found)).alias("shown"), F.when(date.isNotNull(), "published").otherwise("first seen").alias("kind"))

    return let(F.struct(F.to_date(flexible_time(issue, found)).alias("issue"), F.to_date(flexible_time(material, found)).alias("material")), shown)


def title_key(title: Column, most: int = 300) -> Column:
    """What makes two titles the same: letters and digits of the first characters in lower case, one blank between words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?s)<[^>]*>", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(F.lower(F.left(plain, F.lit(most))), r"[^\p{L}\p{N}]+", " "))


def material_id(url: Column, title: Column, published: Column) -> Column:
    """A material's id: from its canonical URL, else from its title and date."""
    basis = F.coalesce(F.nullif(url, F.lit("")), F.concat(title_key(title), F.lit("|"), F.coalesce(published, F.lit(""))))
    return F.left(F.sha2(basis, 256), F.lit(16))


def relative_date(text: Column, as_of: Column) -> Column:
    """The day that words such as `today`, `yesterday` or `3 weeks ago` mean on a given day, or null."""
    low = F.lower(F.trim(text))
    many = F.nullif(F.regexp_extract(low, r"^([0-9]{1,3}) (?:day|week|month)s? ago$", 1), F.lit("")).cast("int")
    unit = F.regexp_extract(low, r"^[0-9]{1,3} (day|week|month)s? ago$", 1)
    return F.when(low.isin("today", "just now"), as_of).when(low == "yesterday", F.date_sub(as_of, 1)).when(unit == "day", F.date_sub(as_of, many)).when(unit == "week", F.date_sub(as_of, many * 7)).when(unit == "month", F.add_months(as_of, -many))


def number(raw: Column) -> Column:
    """A number with separators of thousands and decimals in either style: the last separator is the decimal one, unless three digits follow it alone or it comes more than once."""
    text = F.regexp_replace(F.trim(raw), r"[\s\x{A0}']", "")
    last = F.regexp_extract(text, r"([.,])[0-9]*$", 1)
    once = F.length(F.regexp_replace(text, "[^.,]", "")) == 1
    thousands = (once & text.rlike(r"^[+-]?[1-9][0-9]{0,2}[.,][0-9]{3}$")) | ~F.regexp_replace(text, "[^.,]", "").rlike(r"^(\.*,?|,*\.?)$")
    mixed = text.contains(".") & text.contains(",")
    other = F.when(last == ".", ",").otherwise(".")
    plain = F.when(mixed, F.replace(F.replace(text, other, F.lit("")), F.lit(","), F.lit("."))).when(thousands | (F.length(F.regexp_replace(text, "[^.,]", "")) > 1), F.regexp_replace(text, "[.,]", "")).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def question_key(text: Column) -> Column:
    """What makes two questions the same: letters and digits in lower case, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
