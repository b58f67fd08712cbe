"""Languages told by letters and by function words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that of these languages only one has, in the order in which they are looked for.
MARKS = {"es": "[ñáíó]", "de": "[äöüß]", "fr": "[éèêçà]", "en": "[a-z]"}
#: Words that texts of a language can't do without.
FUNCTION_WORDS = {"en": ("the", "and", "of", "to"), "de": ("der", "die", "und", "das"), "fr": ("les", "des", "et", "la"), "es": ("los", "las", "el", "de")}


def by_marks(text: Column) -> Column:
    """The first language whose mark a text has, else `und`."""
    out = None
    for lang, pattern in MARKS.items():
        out = (F if out is None else out).when(text.rlike(pattern), lang)
    return out.otherwise("und")


def by_function_words(words: Column) -> Column:
    """struct(language, hits, share, sure) of an array of lower-case words: the language with the most function words, equals in the order given; sure with three hits or more and twice the next one's."""
    known = lambda ws: F.size(F.filter(words, lambda w: w.isin(*ws)))
    hits = [known(ws) for ws in FUNCTION_WORDS.values()]
    ranked = F.array_sort(F.array(*[F.struct((-h).alias("less"), F.lit(k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, h) in enumerate(zip(FUNCTION_WORDS, hits, strict=True))]))
    best, second = -ranked[0]["less"], -ranked[1]["less"]
    return F.struct(
        F.when(best > 0, ranked[0]["lang"]).otherwise("und").alias("language"),
        best.alias("hits"),
        F.when(F.size(words) > 0, best / F.size(words)).otherwise(0.0).alias("share"),
        ((best >= 3) & (best >= 2 * second)).alias("sure"),
    )
