"""SimHash fingerprints and near-duplicate components, by segment-popcount embedding.

Contract fingerprints (`near_duplicates`): 64 bits, linked within 2 differing bits, no link missed. Search:
1. equal fingerprints become one row (copies never meet in pairs);
2. the bit counts of 21 segments are a point on a grid, and the Manhattan distance of two points is at most the
   fingerprints' Hamming distance. Points within distance 2 share a cell one step from both, so a fingerprint enters its
   own cell and the cells a step up or down in one segment;
3. fingerprints that share a cell are compared bit by bit. In a cell of more than CROWD of them, no pairs are made:
   there two fingerprints differ in at most 2 bits exactly if some 64-bit value is at most one bit from both, and at
   most 65 fingerprints can be that near to one value, so each is linked to the smallest of its value's group.

Near copies by shingles (`similar`, `keep_one`): the same grid links their fingerprints at 2 bits, and the Jaccard of
their word shingles, 0.8 or more, confirms the links. Beside it, for the near copies that differ in more bits (5 to 14 of
64 are usual, too many for an exact grid), a signature of 256 bits is embedded with segments of one bit (whose count is
the bit): a cell is 20 of those segments and the logarithm of the number of shingles, 64 such cells a text. Texts that
share a cell and differ in at most NEAR_BITS bits of the contract's kind of fingerprint are confirmed in the same way.
Groups are first compared as stars; where a star is not confirmed, all pairs that are not connected yet follow.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import mixed
from skein.operators.components import components
from skein.tables import broadcast_below, looked_up, removed, written

SEED = 42
#: Bits of each segment of the contract's embedding, 64 in all.
SEGMENTS = (3,) * 20 + (4,)
#: Fingerprints of a cell up to which all its pairs are compared.
CROWD = 32
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
STEP = 1 << 14
#: Rows that a broadcast may hold (16 bytes each); more are joined by a shuffle.
FEW = 500_000
#: Rows of one task when fingerprints are put into cells, and members of a cell of which all pairs meet in one join group.
TASK_ROWS, BLOCK = 10_000, 512

#: Cells of a text's 256-bit signature, and the segments of one bit that each has; bits that near copies differ in at most; factor between sizes of one cell.
CELLS, CELL_BITS, NEAR_BITS, SIZES = 64, 20, 20, 4.0
JACCARD = 0.8
SIGNATURE = "struct<fp: bigint, texts: bigint, size: int, cells: array<int>>"
_WORDS = 4
_rng = np.random.default_rng(64)
_CHOSEN = np.array([_rng.choice(64 * _WORDS, CELL_BITS, replace=False) for _ in range(CELLS)])
_SHIFT = _rng.random(CELLS)
del _rng


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; of fewer words, of the whole sequence; none without words."""
    words = text.translate(LOWER).split()  # bytes.split() parts at 0x20 and 0x09-0x0D, and at nothing else
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    begin, end = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    out = np.zeros(len(begin), np.uint64)
    for at in range(0, len(begin), STEP):
        part = [joined[a:b] for a, b in zip(begin[at : at + STEP], end[at : at + STEP], strict=True)]
        out[at : at + STEP] = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
    return out


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of each of the 64 bits: whether more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts * 2 > len(hashes)


def fingerprint_of(text: bytes, shingle: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return int(np.packbits(majority(shingle_hashes(text, shingle)), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of a text column as a long; null and wordless texts have 0."""

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in texts], pa.int64())

    return F.arrow_udf(hashed, T.LongType())(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- links at 2 differing bits ---------------------------------------------------------------


def _cells(value: Column) -> Column:
    """The grid cells of a fingerprint: its segment bit counts packed into one long, and one step up or down in each."""
    own, at, bit = F.lit(0).cast("long"), 0, 0
    steps = []
    for size in SEGMENTS:
        count = F.bit_count(F.shiftrightunsigned(value, bit).bitwiseAND(F.lit((1 << size) - 1))).cast("long")
        own = own + F.shiftleft(count, at)
        steps += [F.when(count < size, F.lit(1 << at)), F.when(count > 0, F.lit(-(1 << at)))]
        bit, at = bit + size, at + size.bit_length()
    return F.transform(F.filter(F.array(F.lit(0).cast("long"), *[s.cast("long") for s in steps]), lambda s: s.isNotNull()), lambda s: own + s)


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fingerprints: DataFrame) -> DataFrame:
    """(a, b) with a < b over distinct fingerprints(fp), a written table: links at 2 or fewer differing bits, enough to connect all that are so linked."""
    total = fingerprints.count()
    spread = fingerprints.select("fp").repartition(-(-total // TASK_ROWS) or 1, "fp")  # a small file would be read by two or three tasks
    placed = spread.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    shared = written(placed.groupBy("cell").agg(F.count("*").alias("many"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("many > 1"), "simhash-cells")
    close = _differ(F.col("a"), F.col("b")) <= 2
    of_two = shared.where("many = 2").where(close).select("a", "b")
    # cells of more: who is in them is read again, and joined to these cells alone
    fuller = broadcast_below(shared.where("many > 2").select("cell", "many"), FEW)
    held = written(placed.join(fuller, "cell"), "simhash-fuller")
    listed = held.where(F.col("many") <= CROWD).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # CROWD at most
    pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (a < b) & (_differ(a, b) <= 2)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    of_few = listed.select(F.explode(pairs).alias("p")).select("p.*")
    crowded = held.where(F.col("many") > CROWD).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(np.uint64(1 << k).astype(np.int64).item()).cast("long") for k in range(64)])
    points = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))  # 65 rows of a point at most
    of_crowds = points.select(least.alias("a"), F.col("fp").alias("b")).where("a < b")
    return of_two.unionByName(of_few).unionByName(of_crowds).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of all rows: component_id is the smallest doc_id reachable by links at 2 differing bits.

    Null and wordless texts have fingerprint 0 and are linked like others. Repeated rows come out as often as they
    come in; a null doc_id takes part and gets its component's smallest id (null if it has no other member).
    Extra columns are not read. A fingerprint that many rows share is joined to them by a broadcast.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-distinct")
    found = components(links(distinct))
    roots = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    members = written(looked_up(roots, written(smallest, "simhash-smallest"), "root", "prints", roots.count()).select("fp", "rows", "component_id"), "simhash-components")
    return looked_up(prints, members, "fp", "rows", prints.count()).select("doc_id", "fp", "component_id")


# --- near copies by shingles -----------------------------------------------------------------


def signature_of(text: bytes, shingle: int) -> tuple[int, int, int, list[int]]:
    """A text's 64-bit SimHash, a digest of its set of shingles, that set's size, and its cells."""
    hashes = shingle_hashes(text, shingle)
    distinct = np.unique(hashes)
    words = [hashes] + [mixed(hashes ^ np.uint64(0xD1B54A32D192ED03 * k & (1 << 64) - 1)) for k in range(1, _WORDS)]
    bits = np.concatenate([majority(w) for w in words])
    cells = bits[_CHOSEN] @ (1 << np.arange(CELL_BITS))
    size = np.floor(np.log(max(1, len(distinct))) / np.log(SIZES) + _SHIFT).astype(np.int64)
    fp = int(np.packbits(bits[:64], bitorder="little").view(np.int64)[0])
    return fp, xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63), len(distinct), (cells | size << CELL_BITS).tolist()


def _signatures(text: Column, shingle: int) -> Column:
    kind = pa.struct([("fp", pa.int64()), ("texts", pa.int64()), ("size", pa.int32()), ("cells", pa.list_(pa.int32()))])

    def signed(texts: pa.Array) -> pa.Array:
        rows = [signature_of(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in texts]
        return pa.array([dict(zip(("fp", "texts", "size", "cells"), r, strict=True)) for r in rows], kind)

    return F.arrow_udf(signed, SIGNATURE)(text)


def _sets(text: Column, shingle: int) -> Column:
    """The distinct shingle hashes of texts, as longs."""
    kind = pa.list_(pa.int64())
    return F.arrow_udf(lambda texts: pa.array([np.unique(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)).view(np.int64) for x in texts], kind), "array<bigint>")(text)


def _placed(signed: DataFrame) -> DataFrame:
    """(cell, texts, fp) of signed(texts, fp, cells), a row for each of a text's cells."""
    spread = signed.repartition(-(-signed.count() // TASK_ROWS) or 1, "texts")
    placed = spread.select("texts", "fp", F.posexplode("cells").alias("k", "c"))
    return placed.select(F.col("k").cast("long").bitwiseOR(F.shiftleft(F.col("c").cast("long"), 8)).alias("cell"), "texts", "fp")


def _crowded(placed: DataFrame) -> DataFrame:
    """The cells of more than CROWD, and how many are in them."""
    return written(placed.groupBy("cell").agg(F.count("*").alias("many")).where(F.col("many") > CROWD).select("cell", "many"), "similar-crowded")


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b) over signed(texts, fp, cells), a written table of one row a set of shingles: pairs that share a cell and differ in NEAR_BITS bits at most.

    In each cell all are compared with the smallest, and those unlike it with all others; in a cell of more than CROWD,
    those unlike the smallest are compared with their own smallest, and so on, until CROWD or fewer are left: a large
    group of near copies thus gives one pair a member, and no cell gives a number of pairs that grows with its square.
    The pairs that are left out are for `apart`, once it is known which texts are connected.
    """
    near = lambda x, y: _differ(x, y) <= NEAR_BITS
    placed = _placed(signed)
    few = broadcast_below(_crowded(placed).select("cell"), FEW)
    parts = [_within_cells(placed.join(few, "cell", "left_anti"), near)]
    rest = written(placed.join(few, "cell"), "similar-rest")
    while rest.limit(1).count():
        first = rest.groupBy("cell").agg(F.min(F.struct(F.col("texts").alias("a"), F.col("fp").alias("afp"))).alias("first")).select("cell", "first.*")
        judged = written(rest.join(broadcast_below(written(first, "similar-first"), FEW), "cell").where("texts <> a").withColumn("close", near(F.col("fp"), F.col("afp"))), "similar-judged")
        parts.append(judged.where("close").select("a", F.col("texts").alias("b")))
        left = judged.where("not close").select("cell", "texts", "fp")
        sizes = written(left.groupBy("cell").agg(F.count("*").alias("many")), "similar-sizes")
        parts.append(_within_cells(left.join(sizes.where(F.col("many") <= CROWD).select("cell"), "cell"), near))
        rest = written(left.join(sizes.where(F.col("many") > CROWD).select("cell"), "cell"), "similar-rest")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _within_cells(placed: DataFrame, near) -> DataFrame:
    """The near pairs within cells of CROWD members at most, save those of two that are both near the smallest."""
    listed = placed.groupBy("cell").agg(F.collect_list(F.struct("texts", "fp")).alias("all")).where(F.size("all") > 1).select("all", F.array_min("all").alias("first"))
    pair = lambda x, y: F.struct(F.least(x["texts"], y["texts"]).alias("a"), F.greatest(x["texts"], y["texts"]).alias("b"))
    like_first = lambda x: near(x["fp"], F.col("first.fp"))
    listed = listed.select("first", F.filter("all", lambda x: like_first(x) & (x["texts"] != F.col("first.texts"))).alias("star"), F.filter("all", lambda x: ~like_first(x)).alias("rest"))
    stars = F.transform("star", lambda x: pair(F.col("first"), x))
    mixed = F.flatten(F.transform("rest", lambda x: F.transform(F.filter("star", lambda y: near(x["fp"], y["fp"])), lambda y: pair(x, y))))
    others = F.flatten(F.transform("rest", lambda x: F.transform(F.filter("rest", lambda y: (x["texts"] < y["texts"]) & near(x["fp"], y["fp"])), lambda y: pair(x, y))))
    return listed.select(F.explode(F.concat(stars, mixed, others)).alias("p")).select("p.*")


def apart(signed: DataFrame, grid: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) over signed(texts, fp, cells): near pairs that pairs(a, b), of grid and candidates, leaves out and roots(node, root) does not connect.

    A star stands for the pairs of its members only if all of it is confirmed. What is confirmed is connected, so here
    only texts of different components meet: those near the same text in pairs (`star`), in a crowded cell (`cell`), or
    in fingerprints that grid(a, b) connects (`grid`). Groups that lie in one component drop out, and the rest meets in
    pairs of blocks of BLOCK members, so no group lies in one task.
    """
    placed = _placed(signed)
    prints = signed.select("texts", "fp")
    starred = pairs.select(F.lit("star").alias("kind"), F.col("a").alias("group"), F.col("b").alias("texts")).join(prints, "texts")
    crowded = placed.join(broadcast_below(_crowded(placed).select("cell"), FEW), "cell").select(F.lit("cell").alias("kind"), F.col("cell").alias("group"), "texts", "fp")
    linked = components(grid).select(F.lit("grid").alias("kind"), F.col("root").alias("group"), F.col("node").alias("texts")).join(prints, "texts")
    held = starred.unionByName(crowded).unionByName(linked).join(roots.select(F.col("node").alias("texts"), "root"), "texts", "left")
    held = written(held.select("kind", "group", "texts", "fp", F.coalesce("root", "texts").alias("label")), "similar-held")
    several = held.groupBy("kind", "group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many"))
    several = written(several.where("low <> high").select("kind", "group", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), "similar-several")
    rest = held.join(broadcast_below(several, FEW), ["kind", "group"]).withColumn("own", F.pmod(F.xxhash64("texts"), "blocks").cast("int"))
    rest = written(rest, "similar-open")
    member = lambda k: [F.col("texts").alias(k), F.col("fp").alias(f"{k}fp"), F.col("label").alias(f"{k}l")]
    x = rest.select("kind", "group", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *member("x"))
    y = rest.select("kind", "group", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), *member("y"))
    most = F.when(F.col("kind") == "grid", 2).otherwise(NEAR_BITS)
    met = x.join(y, ["kind", "group", "i", "j"]).where((F.col("xl") != F.col("yl")) & (_differ(F.col("xfp"), F.col("yfp")) <= most) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked_texts(firsts: DataFrame) -> DataFrame:
    """(a, b) over firsts(texts, fp), a written table of one row a set of shingles: the links of `links` between the smallest sets of two fingerprints, and each set with the smallest of its own."""
    prints = written(firsts.groupBy("fp").agg(F.min("texts").alias("first")), "similar-prints")
    end = lambda k: prints.select(F.col("fp").alias(k), F.col("first").alias(f"t{k}"))
    across = links(prints.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    return across.unionByName(firsts.join(prints, "fp").where("texts <> first").select(F.col("first").alias("a"), F.col("texts").alias("b")))


def _confirmed(pairs: DataFrame, keyed: DataFrame, firsts: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """Those of pairs(a, b), a written table, whose sets of shingles have that Jaccard; firsts(texts, doc_id, text_hash) says which row of keyed has a set's text."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("texts")).distinct().join(firsts.select("texts", "doc_id", "text_hash"), "texts")
    some = broadcast_below(written(some, "similar-some"), FEW)
    same_row = keyed["doc_id"].eqNullSafe(some["doc_id"]) & (keyed["text_hash"] == some["text_hash"])
    sets = keyed.join(some, same_row).select(some["texts"], keyed["text"]).dropDuplicates(["texts"])
    sets = written(sets.select("texts", _sets(F.col("text"), shingle).alias("s")), "similar-sets")
    sa, sb = sets.select(F.col("texts").alias("a"), F.col("s").alias("sa")), sets.select(F.col("texts").alias("b"), F.col("s").alias("sb"))
    shared = pairs.join(sa, "a").join(sb, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    kept = written(shared.where(F.col("both") >= jaccard * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "similar-confirmed")
    removed(sets)
    return kept


def similar(docs: DataFrame, shingle: int = 5, jaccard: float = JACCARD) -> DataFrame:
    """(doc_id, text_hash, texts, component) of all rows: texts is a digest of the row's set of word shingles, component the smallest such digest reachable over pairs of that Jaccard.

    Pairs are verified exactly; how many are found is a matter of the embedding (see the tests for measured recall).
    Null and wordless texts have the same, empty set. text_hash tells rows of equal ids apart. Repeated rows come out
    as often as they come in; extra columns are not read; an empty table gives an empty one.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = written(keyed.select("doc_id", "text_hash", _signatures(F.col("text"), shingle).alias("s")).select("doc_id", "text_hash", "s.*"), "similar")
    firsts = signed.groupBy("texts").agg(F.min(F.struct("doc_id", "text_hash", "fp", "size", "cells")).alias("s"), F.count("*").alias("rows"))
    firsts = written(firsts.select("texts", "rows", "s.*"), "similar-firsts")
    signatures = firsts.select("texts", "fp", "cells")
    grid = written(linked_texts(signatures.select("texts", "fp")), "similar-grid")
    pairs = written(grid.unionByName(candidates(signatures)).distinct(), "similar-pairs")
    linked = _confirmed(pairs, keyed, firsts, shingle, jaccard)
    found = components(linked)
    more = written(apart(signatures, grid, pairs, found).join(pairs, ["a", "b"], "left_anti"), "similar-more")
    if more.limit(1).count():
        found = components(linked.unionByName(_confirmed(more, keyed, firsts, shingle, jaccard)))
    members = written(firsts.select("texts", "rows").join(found, F.col("texts") == F.col("node"), "left").select("texts", "rows", F.coalesce("root", "texts").alias("component")), "similar-members")
    for table in (grid, pairs, linked, more):
        removed(table)
    return looked_up(signed.select("doc_id", "text_hash", "texts"), members, "texts", "rows", signed.count()).select("doc_id", "text_hash", "texts", "component")


def keep_one(docs: DataFrame, shingle: int = 5, jaccard: float = JACCARD) -> DataFrame:
    """docs with one row of each component of near copies (see similar): the one with the smallest doc_id.

    Among rows of that same id the smallest text hash decides; of rows equal in both, any one stays. A row without an id
    stays only if none of its component has one. Rows of other texts with the id of a row that goes are not touched.
    All columns of docs come back as they are, whatever their names; an empty table gives an empty one.
    """
    found = written(similar(docs.select("doc_id", "text"), shingle, jaccard), "similar-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = written(found.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("rows")), "similar-best")
    several = best.where("rows > 1").select("component", "best", "rows")
    placed = looked_up(found, several, "component", "rows", found.count())
    goes = placed.where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))))
    goes = written(goes.select(F.col("doc_id").alias("_skein_id"), F.col("text_hash").alias("_skein_hash")).distinct(), "similar-goes")
    names = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(names.alias("_skein_row"), F.col("doc_id").alias("_skein_doc"), F.xxhash64("text").alias("_skein_text"))
    same = lambda side: rows["_skein_doc"].eqNullSafe(side["_skein_id"]) & (rows["_skein_text"] == side["_skein_hash"])
    few = broadcast_below(goes, FEW)
    again = placed.where(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).groupBy("doc_id", "text_hash").count().where("count > 1")
    again = written(again.select(F.col("doc_id").alias("_skein_id"), F.col("text_hash").alias("_skein_hash")), "similar-again")
    kept = rows.join(few, same(few), "left_anti")
    if again.limit(1).count():
        twice = broadcast_below(again, FEW)
        one = kept.join(twice, same(twice), "left_semi").groupBy("_skein_doc", "_skein_text").agg(F.any_value("_skein_row").alias("_skein_row")).select("_skein_row")
        kept = kept.join(twice, same(twice), "left_anti").select("_skein_row").unionByName(one)
    return kept.select("_skein_row.*")
