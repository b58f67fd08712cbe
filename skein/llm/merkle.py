"""Document fingerprints: Merkle trees over words, paragraphs and sections.

Leaves are runs of LEAF words of a paragraph (a line); a paragraph's digest hashes its leaves' whole digests, a section's
its paragraphs' (sections end after paragraphs whose digest says so, so an edit moves few of them), and the root the
sections', all by SHA-256: equal roots mean equal texts; where roots differ, the branches that differ locate the edit.

A fingerprint is written as root|section=paragraph:leaves,paragraph:leaves;section=... with the first digits of the
digests of sections, paragraphs and leaves; these serve likeness and edits only, equality is decided by whole roots.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 3
#: One paragraph in so many ends a section.
SECTION = 8
_RUN = re.compile(r"\s*(?:\S+\s*){1,%d}|\s+" % LEAF)
#: Hexadecimal digits that are written of a leaf's digest, and of a section's or paragraph's.
WIDTH, SECTION_WIDTH = 8, 16
#: Bytes of text of a range of ids, about.
RANGE_BYTES = 64 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_paragraphs array<int>"


#: A paragraph: its digest and the run of its leaves' digests. A section: its digest and its paragraphs.
Paragraph = tuple[str, str]
Sections = list[tuple[str, list[Paragraph]]]


class Tree:
    """A text's tree; paragraphs that two texts share are hashed once by passing the other's memo."""

    def __init__(self, text: str, memo: dict[str, tuple[bytes, Paragraph]] | None = None):
        self.memo = {} if memo is None else memo
        sha, self.sections, now = hashlib.sha256, [], []
        root = sha(b"text")

        def end() -> None:
            digest = sha(b"".join([p[0] for p in now]))
            root.update(digest.digest())
            self.sections.append((digest.hexdigest()[:SECTION_WIDTH], [p[1] for p in now]))
            now.clear()

        for paragraph in text.split("\n"):
            got = self.memo.get(paragraph)
            if got is None:
                leaves = [sha(leaf.encode("utf-8", "surrogatepass")).digest() for leaf in _RUN.findall(paragraph)]
                whole = sha(b"".join(leaves)).digest()
                got = self.memo[paragraph] = (whole, (whole[: SECTION_WIDTH // 2].hex(), b"".join([leaf[: WIDTH // 2] for leaf in leaves]).hex()))
            now.append(got)
            if got[0][0] % SECTION == 0:
                end()
        end()
        self.root = root.hexdigest()

    @property
    def written(self) -> str:
        return self.root + "|" + ";".join([digest + "=" + ",".join([f"{own}:{run}" for own, run in paragraphs]) for digest, paragraphs in self.sections])


def compared(a: Sections, b: Sections) -> tuple[float, list[int]]:
    """Two trees whose roots differ, from the top down: the share of leaves in branches that both have (Dice), and the numbers of b's paragraphs that a lacks.

    Sections of equal digest are not opened; in the others, paragraphs are compared, and in those that differ, leaves.
    """
    left = Counter(digest for digest, _ in a)
    shared, at, open_b = 0, 0, []
    for digest, paragraphs in b:
        if left[digest] > 0:
            left[digest] -= 1
            shared += sum(len(run) for _, run in paragraphs) // WIDTH
        else:
            open_b += enumerate(paragraphs, at)
        at += len(paragraphs)
    open_a: Counter[Paragraph] = Counter()
    for digest, paragraphs in a:
        if left[digest] > 0:
            left[digest] -= 1
            open_a.update(paragraphs)
    changed = []
    for k, paragraph in open_b:
        if open_a[paragraph] > 0:
            open_a[paragraph] -= 1
            shared += len(paragraph[1]) // WIDTH
        else:
            changed.append((k, paragraph[1]))
    leaves = lambda run: [run[k : k + WIDTH] for k in range(0, len(run), WIDTH)]
    mine: Counter[str] = Counter()
    for (_, run), times in open_a.items():
        if times:
            for leaf in leaves(run):
                mine[leaf] += times
    theirs = Counter(leaf for _, run in changed for leaf in leaves(run))
    shared += sum((mine & theirs).values())
    total = sum(len(run) for tree in (a, b) for _, paragraphs in tree for _, run in paragraphs) // WIDTH
    return (2 * shared / total if total else 1.0), [k for k, _ in changed]


def sections_of(written: str) -> Sections:
    parts = (part.split("=", 1) for part in written.split("|", 1)[1].split(";"))
    return [(digest, [tuple(p.split(":", 1)) for p in paragraphs.split(",") if p]) for digest, paragraphs in parts]


def likeness(a: str, b: str) -> float:
    """Share of leaves that two written fingerprints have in common, 1.0 for equal roots."""
    return 1.0 if a.split("|", 1)[0] == b.split("|", 1)[0] else compared(sections_of(a), sections_of(b))[0]


def edits(a: str, b: str) -> list[int]:
    """Numbers of the paragraphs of b that are in no branch of a: where b was edited."""
    return [] if a.split("|", 1)[0] == b.split("|", 1)[0] else compared(sections_of(a), sections_of(b))[1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of each row: its fingerprint, that of its edited text, both likenesses, and the paragraphs of the edited text (from 0) that its own tree lacks.

    The edited text has the last half of the code points replaced by the first as many of the next document in order of
    doc_id (after the last, the first). Rows are put into ranges of doc_id (of about RANGE_BYTES of text, and as many as shuffles have partitions at least), one a partition, sorted, and read with the
    row after; the first row of each range is also sent to the range before. A null text is empty. Rows with equal ids
    follow each other in an order set by their text; rows without an id come first, and are no one's next but each other's.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // RANGE_BYTES))
    # as many bounds as there are partitions, whatever the number of rows
    cuts = rows.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    if cuts:
        bounds = F.array(*[F.lit(c) for c in cuts])
        place = F.when(F.col("doc_id").isNull(), 0).otherwise(F.array_size(F.filter(bounds, lambda c: c <= F.col("doc_id")))).cast("int")
    else:
        place = F.lit(0)
    heads = docs.where("doc_id is not null").select("doc_id", place.alias("place")).groupBy("place").agg(F.min("doc_id").alias("head")).orderBy("place").collect()
    after = [(heads[(k + 1) % len(heads)]["head"], h["place"]) for k, h in enumerate(heads)]  # a row a partition at most
    # an empty last range needs no row after it; the ranges between hold at least their bound
    nexts = spark.createDataFrame(after, "doc_id long, before int") if after else spark.createDataFrame([], "doc_id long, before int")
    sent = rows.withColumn("place", place).join(F.broadcast(nexts.groupBy("doc_id").agg(F.collect_list("before").alias("before"))), "doc_id", "left")
    copies = F.concat(F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("extra"))), F.transform(F.coalesce("before", F.array().cast("array<int>")), lambda b: F.struct(b.alias("place"), F.lit(1).alias("extra"))))
    dealt = sent.select("doc_id", "text", F.explode(copies).alias("to")).select("to.place", "to.extra", "doc_id", "text")
    sorted_rows = dealt.repartitionById(many, F.col("place")).sortWithinPartitions("extra", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def one(doc_id: int | None, text: str, following: str, tree: Tree) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = Tree(edited, tree.memo)
        nxt = Tree(following)
        near, changed = (1.0, []) if other.root == tree.root else compared(tree.sections, other.sections)
        near_next = 1.0 if nxt.root == tree.root else compared(tree.sections, nxt.sections)[0]
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.written, other.written, near, near_next, changed), nxt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: tuple | None = None
        tree: Tree | None = None
        first: str | None = None
        ended = False
        out: list[tuple] = []
        for batch in batches:
            for extra, doc_id, text in zip(batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ended or extra and held is None:
                    continue
                if held is not None:
                    row, tree = one(held[0], held[1], text, tree if tree is not None else Tree(held[1]))
                    out.append(row)
                if extra:
                    ended = True
                else:
                    held = (doc_id, text)
                    first = text if first is None else first
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_ARROW)
                    out = []
        if held is not None and not ended:  # only where no row of the table has an id
            out.append(one(held[0], held[1], first or "", tree if tree is not None else Tree(held[1]))[0])
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_ARROW)

    return sorted_rows.select("extra", "doc_id", "text").mapInArrow(run, SCHEMA)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])
