"""Whether what a clause says is in the evidence that it cites: numbers, symbols, names, quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What must be the same in both, by kind.
KINDS = {
    "number": r"(?<![\p{L}\p{N}_])([0-9]+(?:[.,\x{A0} ][0-9]{3})*(?:[.,][0-9]+)?)",
    "symbol": r"([%‰°§±$€£¥₽])",
    "name": r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)",
}
#: Words up to which a quotation is a term rather than an utterance.
TERM_WORDS = 3


def tokens(text: Column) -> Column:
    """An array of struct(kind, token) of what a text says exactly; numbers without their separators of thousands."""
    found = []
    for kind, pattern in KINDS.items():
        values = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
        if kind == "number":
            values = F.transform(values, lambda x: F.replace(F.regexp_replace(x, r"[.,\x{A0} ](?=[0-9]{3}(?![0-9]))", ""), F.lit(","), F.lit(".")))
        found.append(F.transform(values, _of(kind)))
    return F.concat(*found)


def _of(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("token"))


def counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, token, n)"""
    return rows.select(key, F.explode(tokens(F.col(text))).alias("x")).groupBy(key, "x.kind", "x.token").agg(F.count("*").alias("n"))


def unsupported(clauses: DataFrame, cited: DataFrame, evidence: DataFrame, clause: str, source: str, text: str, same_count: bool = False) -> DataFrame:
    """(clause, kind, token, wanted, had): what clauses(clause, text) say that the evidence cited(clause, source) for them in evidence(source, text) doesn't.

    Evidence is counted once, however many clauses cite it, and meets the clauses as counted tokens only; clauses
    without citations have nothing to stand on. With same_count, as for translations, a token must come exactly as often.
    """
    wanted = counted(clauses, clause, text).withColumnRenamed("n", "wanted")
    had = cited.select(clause, source).distinct().join(counted(evidence, source, text), source).groupBy(clause, "kind", "token").agg(F.sum("n").alias("had"))
    both = wanted.join(had, [clause, "kind", "token"], "full" if same_count else "left").select(clause, "kind", "token", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("had", F.lit(0)).alias("had"))
    return both.where("wanted <> had" if same_count else "had = 0")


def unfound_quotations(clauses: DataFrame, cited: DataFrame, evidence: DataFrame, clause: str, source: str, text: str) -> DataFrame:
    """(clause, quotation) of utterances in quotation marks, of more than TERM_WORDS words, that no cited evidence holds."""
    said = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('["“«„]([^"“”«»„]+)["”»]'), 1)
    quoted = clauses.select(clause, F.explode(F.array_distinct(F.transform(said, F.trim))).alias("quotation")).where(F.size(F.split("quotation", r"\s+")) > TERM_WORDS)
    offered = quoted.join(cited.select(clause, source).distinct(), clause).join(evidence.select(source, F.col(text).alias("_offered")), source)
    found = offered.where(F.col("_offered").contains(F.col("quotation"))).select(clause, "quotation").distinct()
    return quoted.join(found, [clause, "quotation"], "left_anti")
