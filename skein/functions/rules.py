"""Rules over the columns of a row: term scores, ordered verdicts, gates that name the first or every defect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms_present(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text has, each counted once."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])


def first_of(cases: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first condition that holds."""
    out = F.when(F.coalesce(cases[0][1], F.lit(False)), cases[0][0])
    for name, condition in cases[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(F.lit(otherwise))


def weighted_ranking(scores: dict[str, Column], most: int) -> Column:
    """The names with a positive score, best first, equals in the order given, `most` at most."""
    entries = F.array(*[F.struct((-score).alias("less"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, score) in enumerate(scores.items())])
    some = F.array_sort(F.filter(entries, lambda x: x["less"] < 0))
    return F.transform(F.slice(some, 1, most), lambda x: x["name"])


def clamped(score: Column, floors: list[tuple[Column, float]], caps: list[tuple[Column, float]]) -> Column:
    """A score raised to the floors whose condition holds, then lowered to the caps whose condition holds: caps win."""
    for condition, floor in floors:
        score = F.when(condition, F.greatest(score, F.lit(floor))).otherwise(score)
    for condition, cap in caps:
        score = F.when(condition, F.least(score, F.lit(cap))).otherwise(score)
    return score


#: Letters whose single capital is another than the several that F.upper gives: ß, and Greek ones with an iota below.
_SMALL = "ß" + "".join(chr(k) for start in (0x1F80, 0x1F90, 0x1FA0) for k in range(start, start + 8)) + "\u1fb3\u1fc3\u1ff3"
_CAPITAL = "ẞ" + "".join(chr(k + 8) for start in (0x1F80, 0x1F90, 0x1FA0) for k in range(start, start + 8)) + "\u1fbc\u1fcc\u1ffc"


def capitals(text: Column) -> Column:
    """Upper case letter by letter, as SQL gives it: ß has ẞ, and a letter with no single capital stays as it is, so a text keeps its length."""
    each = F.transform(F.split(F.translate(text, _SMALL, _CAPITAL), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c))
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(F.array_join(each, ""))


def title_problem(title: Column) -> Column:
    """Why a title won't do, or null: missing, an address, markup, too short, no letters, shouted."""
    bare = F.regexp_replace(title, r"\A\p{Zs}+|\p{Zs}+\z", "")
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    return first_of(
        [
            ("missing", bare.isNull() | (bare == "")),
            ("address", bare.rlike(r"\A(https?://|www\.)[^\t\n\f\r ]+\z")),
            ("markup", bare.rlike(r"<[A-Za-z/][^>]*>|&[a-z]+;")),
            ("letterless", letters == ""),
            ("short", F.length(bare) < 12),
            ("shouted", (F.length(letters) > 8) & (letters == capitals(letters)) & (letters != F.lower(letters))),
        ]
    )


def hidden_values(text: Column) -> Column:
    """The kinds of values in a text that must not be published: local paths, keys and tokens, addresses of persons."""
    kinds = {"path": r"(^|[\s\"'(])(/home/|/root/|/Users/|[A-Z]:\\)", "secret": r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*\S{6,}", "address": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"}
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]), lambda x: x.isNotNull())


def scrubbed(text: Column) -> Column:
    """A text with local paths, secrets and mail addresses put out of sight."""
    out = F.regexp_replace(text, r"(/home|/root|/Users)/[^\s\"')]*", "[path]")
    out = F.regexp_replace(out, r"(?i)((?:api[_-]?key|secret|token|password)\s*[:=]\s*)\S{6,}", "$1[secret]")
    return F.regexp_replace(out, r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "[address]")
