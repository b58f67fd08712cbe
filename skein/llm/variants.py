"""Spelling variants: words one edit apart, found by bitsets over the vocabulary.

A block of the vocabulary is indexed by place and letter: bit w of the set (place, letter) says that word w has that
letter there. A word asked for is read once from left to right, for all words of a block at a time: one set holds the
words that match without an error so far, and three hold those with one error, by how far their places are shifted (none
after a replaced letter, one on after an inserted one, one back after a deleted one). Whole sets are carried forward by
"and" and "or" of 64 words a step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.tables import broadcast_below, removed, written

#: Most words of a block, and words that are read at a time.
BLOCK, ASKED = 16_384, 64
LETTERS = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, divisor: int = 199) -> DataFrame:
    """(word) of every run of letters of every text, lower-cased by A-Z only; where `divisor` divides the crc32 of "<doc_id>:<run>", the run without its code point number crc32 % length.

    A null text has no runs; a row without an id counts with an empty one.
    """
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({LETTERS})"), 1)
    flat = docs.where(F.col("text").isNotNull()).select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(found).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    hashed = flat.where(F.length("run") >= 6).select("run", h.alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), place), F.substr("run", place + 2))
    return hashed.select(F.when(F.col("h") % divisor == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, length: int = 6, times: int = 5) -> DataFrame:
    """(word, n) of the distinct words of at least so many code points that occur so often; counts merge before the shuffle."""
    long = runs(docs).where(F.length("word") >= length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


class PositionIndex:
    """Bitsets over words by place and letter, and by length."""

    def __init__(self, words: list[str]):
        self.many = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(self.many), sizes)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.places = int(sizes.max(initial=0))
        self.alphabet = np.unique(letters)
        self.none = len(self.alphabet)  # the letter that no word has
        self.chunks = -(-self.many // 64)
        bits = np.zeros((self.places + 2, self.none + 1, self.chunks * 8), np.uint8)  # two places beyond the last, as shifts reach them
        np.bitwise_or.at(bits, (place, np.searchsorted(self.alphabet, letters), word >> 3), (1 << (word & 7)).astype(np.uint8))
        self.at = bits.view(np.uint64)
        self.sizes = sizes
        self.everyone = np.packbits(np.arange(self.chunks * 64) < self.many, bitorder="little").view(np.uint64)

    def _of_size(self, size: int) -> np.ndarray:
        return np.packbits(np.pad(self.sizes == size, (0, self.chunks * 64 - self.many)), bitorder="little").view(np.uint64)

    def one_edit_from(self, asked: list[str]) -> np.ndarray:
        """Bitsets, a row for each of the words asked for, all of one length: the words exactly one edit away."""
        size = len(asked[0])
        letters = np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32).reshape(len(asked), size)
        code = np.searchsorted(self.alphabet, letters)
        code = np.where(self.alphabet[np.minimum(code, self.none - 1)] == letters, code, self.none)
        exact = np.repeat(self.everyone[None, :], len(asked), axis=0)
        replaced = np.zeros_like(exact)
        longer, shorter = np.zeros_like(exact), np.zeros_like(exact)  # words with a letter more, with one less
        for i in range(size):
            here = self.at[min(i, self.places + 1), code[:, i]]
            on = self.at[min(i + 1, self.places + 1), code[:, i]]
            longer = (longer | exact) & on
            shorter = exact | (shorter & self.at[min(i - 1, self.places + 1), code[:, i]]) if i else exact.copy()
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
        longer |= exact
        return (replaced & self._of_size(size)) | (longer & self._of_size(size + 1)) | (shorter & self._of_size(size - 1))


def _near(asked: pa.Table, block: pa.Table) -> pa.Table:
    """Of the words asked for that have near ones in the block: how many, and the best of them (the most frequent, then the smallest)."""
    words, counts = block["word"].to_pylist(), block["n"].to_numpy()
    # the best comes first: one pass over the set bits in order finds it. UTF-8 orders as code points do
    order = np.lexsort((np.argsort(np.argsort(np.array([w.encode("utf-32-be") for w in words], object))), -counts))
    words, counts = [words[k] for k in order.tolist()], counts[order]
    index = PositionIndex(words)
    given = sorted(asked["word"].to_pylist())  # of one length
    out: list[tuple[str, int, str, int]] = []
    for at in range(0, len(given), ASKED):
        some = given[at : at + ASKED]
        found = index.one_edit_from(some)
        for k in np.flatnonzero(found.any(axis=1)).tolist():
            near = np.flatnonzero(np.unpackbits(found[k].view(np.uint8), bitorder="little"))
            out.append((some[k], len(near), words[near[0]], int(counts[near[0]])))
    names = ("word", "n_near", "best", "best_n")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.table({c: pa.array([row[k] for row in out], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of words(word, n) with words exactly one edit away; form is the most frequent of these, the smallest of equals.

    Words are put into blocks by length and, where many have one length, by a hash; a block meets those of its own and
    the neighbouring lengths, by an equal join of the tiles' numbers. A tile gives a row a word, so no list of pairs grows with the vocabulary.
    """
    sizes = words.groupBy(F.length("word").alias("size")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = written(sizes, "word-lengths")  # a row a length
    sized = words.select("word", "n", F.length("word").alias("size"))
    plain = broadcast_below(sizes, 100_000)
    rows = sized.join(plain, "size").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).drop("blocks")
    near = sized.select("size").distinct().select("size", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("other"))
    tiles = near.join(sizes.select(F.col("size").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block")), "other")  # a row a length and block
    tiles = broadcast_below(written(tiles, "word-tiles"), 100_000)
    left = rows.join(tiles, "size").select(F.col("size").alias("_a"), F.col("block").alias("_ab"), F.col("other").alias("_b"), F.col("other_block").alias("_bb"), "word")
    right = rows.join(tiles, "size").select(F.col("other").alias("_a"), F.col("other_block").alias("_ab"), F.col("size").alias("_b"), F.col("block").alias("_bb"), F.col("word").alias("word"), F.col("n").alias("n"))
    keys = ["_a", "_ab", "_b", "_bb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_near_in_tile, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("form"), (-F.col("b.less")).alias("form_n"))


def _near_in_tile(asked: pa.Table, block: pa.Table) -> pa.Table:
    if not asked.num_rows or not block.num_rows:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.string()), "best_n": pa.array([], pa.int64())})
    return _near(asked, block)


def spelling_groups(docs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Null and empty texts, and texts without letters, give no words; repeated rows count as often as they occur; other
    columns are not read; an empty table has no words. A word with no near word that is `ratio` times as frequent has no
    form and is its own root; ties between near words go to the smallest in code-point order. Forms have more
    occurrences than their words, so following them ends; each round below doubles how far it has come.
    """
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words)
    fits = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near.withColumnsRenamed({"form": "best", "form_n": "best_n"}), "word", "left")
    rows = written(joined.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    roots = written(roots, "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        removed(roots)
        roots = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
