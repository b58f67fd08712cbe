"""Stems of English and German words by the published Snowball rules; distinct words are stemmed once."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.tables import written

# Fixed values of the English rules: whole words with their stems, and words left as they are after step 1a.
ENGLISH_WORDS = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
LI = "cdeghkmnrt"
# Fixed values of the German rules.
GERMAN_S, GERMAN_ST = "bdfghklmnrt", "bdfghklmnt"


def _region(word: str, start: int, vowels: str) -> int:
    """Where the part after the first non-vowel that follows a vowel begins, from `start` on."""
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word)) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", word))


def english(word: str) -> str:
    """Porter's second algorithm."""
    if len(word) < 3:
        return word
    word = word.removeprefix("'")
    if word in ENGLISH_WORDS:
        return ENGLISH_WORDS[word]
    vowels = "aeiouy"
    word = re.sub(f"(^|[{vowels}])y", r"\1Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0, vowels)
    r2 = _region(word, r1, vowels)
    # 0 and 1a
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    end = _longest(word, ("sses", "ied", "ies", "s", "us", "ss"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search(f"[{vowels}]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # 1b and 1c
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{vowels}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in vowels:
        word = word[:-1] + "i"
    # 2
    end = _longest(word, (*STEP2, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if len(word) > 2 and word[-3] in LI else word
        else:
            word = word[: -len(end)] + STEP2[end]
    # 3
    end = _longest(word, (*STEP3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end != "ative":
            word = word[: -len(end)] + STEP3[end]
        elif len(word) - len(end) >= r2:
            word = word[: -len(end)]
    # 4
    end = _longest(word, (*STEP4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    # 5
    if word.endswith("e") and (len(word) > r2 or len(word) > r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) > r2:
        word = word[:-1]
    return word.replace("Y", "y")


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{vowels}])u(?=[{vowels}])", "U", word)
    word = re.sub(f"(?<=[{vowels}])y(?=[{vowels}])", "Y", word)
    first = _region(word, 0, vowels)
    r1, r2 = max(3, first) if first < len(word) else len(word), _region(word, first, vowels)

    def held(end: str, region: int) -> bool:
        return bool(end) and len(word) - len(end) >= region

    # 1
    end = _longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if held(end, r1) and (end != "s" or word[-2:-1] and word[-2] in GERMAN_S):
        word = word[: -len(end)]
        if end in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    # 2
    end = _longest(word, ("en", "er", "est", "st"))
    if held(end, r1) and (end != "st" or len(word) > 5 and word[-3] in GERMAN_ST):
        word = word[: -len(end)]
    # 3
    end = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if held(end, r2):
        before = word[: -len(end)]
        if end in ("end", "ung"):
            word = before
            if word.endswith("ig") and not word.endswith("eig") and len(word) - 2 >= r2:
                word = word[:-2]
        elif end in ("ig", "ik", "isch"):
            word = word if before.endswith("e") else before
        elif end in ("lich", "heit"):
            word = before
            more = _longest(word, ("er", "en"))
            word = word[:-2] if held(more, r1) else word
        else:
            word = before
            more = _longest(word, ("lich", "ig"))
            word = word[: -len(more)] if held(more, r2) else word
    return word.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


RULES = {"en": english, "de": german}


def stem(word: Column, language: Column) -> Column:
    """The stem of a lower-case word by its language's rules; words of other languages stay as they are."""

    def run(words: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.array([w if w is None or n not in RULES else RULES[n](w) for w, n in zip(words.to_pylist(), languages.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(word, language)


def stemmed(rows: DataFrame, word: str, language: str) -> DataFrame:
    """(language, word, stem) of the distinct words of rows."""
    # written, as Spark moves filters on the stem, such as a join's, below `distinct`, where each mention of a word would be stemmed
    words = written(rows.select(F.col(language).alias("language"), F.col(word).alias("word")).distinct(), "distinct-words")
    return words.withColumn("stem", stem(F.col("word"), F.col("language")))
