"""Events told more than once: exact copies, pairs that a person must look at, and groups that may be merged.

An event row has id (long), title, summary, evidence, subject, action, object, event_type (strings), event_date (date or
null), products, organizations, facts (arrays of strings), full (boolean: its whole text is known) and source_type.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import tiling
from skein.operators.retrieval import tokens
from skein.tables import written

# Days between two tellings, share of words, ratio of titles and their words.
WINDOW, WORDS, TITLES, TITLE_WORDS = 7, 0.55, 0.96, 5
#: What two rows may be said to share.
REASONS = ("id", "address", "title and date")
#: Why a pair is looked at, and what is said of it.
BY, VERDICTS = ("entity", "words", "title"), ("review", "separate", "conflict")
#: Rows of a block whose pairs with another block are one task, and pairs that it gives at a time.
BLOCK_ROWS, PAIRS = 1 << 14, 1 << 20
BLOCK = ["subject", "action", "object", "event_type", "event_date"]


def plain(text: Column) -> Column:
    """Words in lower case, one blank between them."""
    return F.array_join(tokens(F.coalesce(text, F.lit(""))), " ")


def plain_set(values: Column) -> Column:
    """The distinct plain forms of an array's strings, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), plain)))


def rank(row: str = "") -> Column:
    """Which telling stands for an event, the largest first: whole text, primary source, a date, many facts, news, the larger id."""
    c = lambda name: F.col(row + name)
    flag = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    kind = c("source_type")
    return F.struct(flag(c("full")).alias("full"), flag(kind == "primary").alias("primary"), flag(c("event_date").isNotNull()).alias("dated"), F.greatest(F.size(c("facts")), F.lit(0)).alias("facts"), flag(kind == "news").alias("news"), c("id").alias("id"))


def cluster_key(row: str = "") -> Column:
    """A name made from what an event is: its plain subject, action, object, date and products, and its evidence where it has no date."""
    c = lambda name: F.col(row + name)
    fields = F.array(plain(c("subject")), plain(c("action")), plain(c("object")), F.coalesce(c("event_date").cast("string"), F.lit("")))
    proof = F.when(c("event_date").isNull(), F.array(plain(c("evidence")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("evt_"), F.left(F.sha2(F.to_json(F.concat(fields, plain_set(c("products")), proof)), 256), F.lit(24)))


def exact_copies(rows: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """(id, first, reason): each row with the smallest id that it shares a key with, by the first of keys (reason, key) that joins it to another row; null keys join nothing.

    A group is one aggregate a key, merged before the shuffle, and its smallest id comes back by a join on the key's
    digest, so no list of a group's members is made.
    """
    keyed = written(rows.select("id", *[F.when(k.isNotNull(), F.sha2(k, 256)).alias(f"k{n}") for n, (_, k) in enumerate(keys)]), "copy-keys")
    joined = keyed
    for n in range(len(keys)):
        groups = keyed.where(F.col(f"k{n}").isNotNull()).groupBy(f"k{n}").agg(F.min("id").alias(f"first{n}"), F.count_distinct("id").alias(f"many{n}"))
        joined = joined.join(groups.where(F.col(f"many{n}") > 1), f"k{n}", "left")
    found = F.coalesce(*[F.when(F.col(f"first{n}").isNotNull(), F.struct(F.col(f"first{n}").alias("first"), F.lit(reason).alias("reason"))) for n, (reason, _) in enumerate(keys)])
    return joined.select("id", found.alias("f")).where("f is not null").select("id", "f.first", "f.reason")


def merged(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, chosen), each event with the event that stands for its group, and (a, b), groups by those events that could neither be merged nor told apart.

    Two events may be one if subject, action, object, type and date are the same, and they have a product in common or
    both have none. A group holds only events that may all be one, pairwise (complete link): in the order of rank each
    event joins the first group that it fits. A pair that may be one but fell into two groups is a conflict. Events
    without a date stay alone.

    Equal sets of products in a block of equal fields act alike, so a block is first cut to one row for each of its
    sets, by an aggregate that is merged before the shuffle: copies of one story, however many, are one row. The greedy
    pass reads sorted rows and finds the groups that a set meets through an index of products.
    """
    fields = [F.coalesce(plain(F.col(c)), F.lit("")).alias(c) if c != "event_date" else F.col(c) for c in BLOCK]
    rows = written(events.select("id", rank().alias("rank"), *fields, plain_set(F.col("products")).alias("products")), "events")
    sets = rows.where("event_date is not null").groupBy(*BLOCK, "products").agg(F.max("rank").alias("rank"))
    sets = sets.select(F.xxhash64(*BLOCK).alias("part"), F.struct(*BLOCK).alias("block"), "products", "rank", F.col("rank.id").alias("first"))
    ordered = sets.repartition("part").sortWithinPartitions("part", "block", F.desc("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        groups: list[tuple[int, int]] = []  # the event that stands for a group, and how many sets it has
        holders: dict[str, set[tuple[int, int]]] = {}  # product: (group, place in it) of the sets with it
        for batch in batches:
            out = []
            for block, products, first in zip(batch["key"], batch["products"], batch["first"], strict=True):
                if block != now:
                    now, groups, holders = block, [], {}
                names = list(products) or [""]  # sets without products are alike, and like no other
                met: dict[int, set[int]] = {}
                for name in names:
                    for group, place in holders.get(name, ()):
                        met.setdefault(group, set()).add(place)
                fits = min((g for g, places in met.items() if len(places) == groups[g][1]), default=len(groups))
                if fits == len(groups):
                    groups.append((first, 0))
                chosen, many = groups[fits]
                for name in names:
                    holders.setdefault(name, set()).add((fits, many))
                groups[fits] = (chosen, many + 1)
                out.append((first, chosen, False))
                out += [(min(chosen, groups[g][0]), max(chosen, groups[g][0]), True) for g in met if g != fits]
            yield pd.DataFrame(out, columns=["x", "y", "conflict"])

    made = ordered.select(F.to_json("block").alias("key"), "products", "first").mapInPandas(run, "x long, y long, conflict boolean")
    made = written(made, "merged")
    firsts = sets.select("first", "block", "products")
    chosen = firsts.join(made.where("not conflict").select(F.col("x").alias("first"), F.col("y").alias("chosen")), "first")
    dated = rows.where("event_date is not null").select("id", F.struct(*BLOCK).alias("block"), "products")
    members = dated.join(chosen.select("block", "products", "chosen"), ["block", "products"], "left").select("id", F.coalesce("chosen", "id").alias("chosen"))
    alone = rows.where("event_date is null").select("id", F.col("id").alias("chosen"))
    return members.unionByName(alone), made.where("conflict").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of lists, and where each row's begin, with the end."""
    return column.combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(tiling.widths(column))])


def _bins(texts: list[str], width: int, bins: int) -> np.ndarray:
    """How many runs of `width` characters of each text fall into each of some bins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    last = max(0, len(points) - width + 1)
    whole = rows[:last] == rows[len(rows) - last :]  # runs that lie in one text
    runs = sum(points[n : last + n] * 31**n for n in range(width))
    return np.bincount((rows[:last] * bins + runs % bins)[whole], minlength=len(texts) * bins).reshape(len(texts), bins).astype(np.int16)


class _Titles:
    """Titles of a block, with bounds of their likeness that numpy takes of many at once."""

    def __init__(self, titles: pa.ChunkedArray):
        self.text = titles.to_pylist()
        self.long = np.array([len(t) for t in self.text], np.int64)
        self.words = np.array([t.count(" ") + 1 for t in self.text], np.int64)
        self.letters, self.couples = _bins(self.text, 1, 64), _bins(self.text, 2, 128)
        self.few = self.letters.reshape(-1, 8, 8).sum(axis=2, dtype=np.int16)  # the letters in fewer bins
        self.order = np.argsort(self.long, kind="stable")
        self.sorted, self.by_length = self.long[self.order], np.ascontiguousarray(self.few[self.order].T)

    def near(self, x: _Titles, row: int) -> np.ndarray:
        """The rows whose title has nearly the length and letters of that row's of x, which all that are alike have."""
        long = int(x.long[row])
        part = slice(np.searchsorted(self.sorted, TITLES / (2 - TITLES) * long - 1e-6, "left"), np.searchsorted(self.sorted, (2 - TITLES) / TITLES * long + 1e-6, "right"))
        shared = np.minimum(self.by_length[:, part], x.few[row][:, None]).sum(axis=0, dtype=np.int32)
        return self.order[part][shared >= TITLES / 2 * (self.sorted[part] + long) - 1e-6]

    def like(self, x: _Titles, row: int, some: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Those of some rows whose title and that row's of x are alike; `first` says which of some have the smaller key, whose title needs words enough.

        Alike titles have M letters in common, and as matching blocks are parted by letters that don't match, all
        runs of two letters but one a block.
        """
        both = self.long[some] + x.long[row]
        fits = (2 * np.minimum(self.long[some], x.long[row]) >= TITLES * both) & (np.where(first, self.words[some], x.words[row]) >= TITLE_WORDS)
        some, first, both = some[fits], first[fits], both[fits]
        least = np.ceil(TITLES * both / 2 - 1e-9)
        fits = np.minimum(self.letters[some], x.letters[row]).sum(axis=1) >= least
        some, first, both, least = some[fits], first[fits], both[fits], least[fits]
        fits = np.minimum(self.couples[some], x.couples[row]).sum(axis=1) >= 3 * least - both - 1
        some, first = some[fits], first[fits]
        mine = x.text[row]
        return some[np.fromiter((_alike(self.text[k], mine) if f else _alike(mine, self.text[k]) for k, f in zip(some, first, strict=True)), bool, len(some))]


def _alike(a: str, b: str) -> bool:
    """Whether the matching blocks of two titles make up TITLES of both; cheaper upper bounds are looked at first."""
    if a == b and len(a) < 200:  # from there on the matcher leaves frequent letters out
        return True
    s = SequenceMatcher(None, a, b)
    return s.real_quick_ratio() >= TITLES and s.quick_ratio() >= TITLES and s.ratio() >= TITLES


def _met(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, by, verdict) of the pairs of two blocks, by and verdict as places in BY and VERDICTS; a row of x at a time."""
    y = y.sort_by("day")
    days = y["day"].drop_null().to_numpy()  # those without a day are last
    ids, many = y["id"].to_numpy(), y.num_rows
    words, names, told = (tiling.postings(y[c]) for c in ("words", "names", "told"))
    size = tiling.widths(y["words"])
    subjects, actions = y["subject"].to_numpy(), y["action"].to_pandas().astype("Int64")
    acts, acted = actions.fillna(0).to_numpy(np.int64), actions.notna().to_numpy()
    titles = _Titles(y["title"])
    others = _Titles(x["title"])
    lists = [_lists(x[c]) for c in ("words", "names", "told")]
    spans = [(np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")) for (items, _), (mine, _) in zip((words, names, told), lists, strict=True)]

    def rows_with(kind: int, r: int) -> np.ndarray:
        """The rows of y that hold an item of row r of x, once for each."""
        (low, high), at, rows = spans[kind], lists[kind][1], (words, names, told)[kind][1]
        return np.concatenate([rows[:0], *[rows[low[k] : high[k]] for k in range(at[r], at[r + 1])]])

    need = lambda n: np.maximum(1, np.ceil(WORDS * n - 1e-9)).astype(np.int64)
    least, leasts = need(size), need(tiling.widths(x["words"]))
    by = np.full(many, len(BY), np.int8)
    out, made = [], 0
    for r, (key, day, subject, action) in enumerate(zip(*[x[c].to_pylist() for c in ("id", "day", "subject", "action")], strict=True)):
        first, end = (0, len(days)) if day is None else np.searchsorted(days, [day - WINDOW, day + WINDOW + 1])

        def fit(some: np.ndarray, first: int = first, end: int = end, key: int = key) -> np.ndarray:
            """Those of some rows that are near enough in time, and whose pair with this row is not another row's."""
            near = (some >= len(days)) | (some >= first) & (some < end)
            return some[near & (ids[some] > key if same else ids[some] != key)]

        shared = np.bincount(rows_with(0, r), minlength=many)
        worded = fit(np.flatnonzero(shared >= np.minimum(least, leasts[r])))
        named = fit(rows_with(1, r))
        by[worded] = 1
        by[named] = 0
        rest = fit(titles.near(others, r))
        rest = rest[by[rest] == len(BY)]
        titled = titles.like(others, r, rest, ids[rest] < key)
        by[titled] = 2
        hit = np.unique(np.concatenate([worded, named, titled]))
        kinds = by[hit]
        by[hit] = len(BY)
        if not len(hit):
            continue
        verdict = np.zeros(len(hit), np.int8)
        if day is not None and action is not None:
            dated = hit[hit < len(days)]  # hits are in order
            verdict[: len(dated)] = (subjects[dated] == subject) & acted[dated] & (acts[dated] != action) & (days[dated] != day)
        verdict[np.isin(hit, rows_with(2, r))] = 2
        out.append((np.minimum(ids[hit], key), np.maximum(ids[hit], key), kinds, verdict))
        made += len(hit)
        if made > PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "by", "verdict"])
            out, made = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "by", "verdict"])


def for_review(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, chosen) as merged, and (a, b, by, verdict) of pairs of chosen events, at most WINDOW days apart (or without a date), that name an entity in common, share enough words, or have nearly the same title.

    The verdict is `conflict` for groups that complete link kept apart, `separate` for the same subject with different
    actions on different known days, and else `review`. Members of a group are in the first table, so pairs between them are not listed.

    Events meet in pairs of blocks (tiling.met), with what a pair is judged by, and only pairs of the result leave a
    task. Groups conflict where blocks of equal fields have a product in common, which their events carry (`told`).
    """
    events = written(events, "told-events")  # read three times
    members = written(merged(events)[0], "members")
    fields = F.xxhash64(*[F.coalesce(plain(F.col(c)), F.lit("")) if c != "event_date" else F.col(c) for c in BLOCK])
    products = events.where("event_date is not null").select("id", fields.alias("part"), F.explode(plain_set(F.col("products"))).alias("product"))
    told = products.join(members, "id").groupBy(F.col("chosen").alias("id")).agg(F.collect_set(F.xxhash64("part", "product")).alias("told"))
    chosen = events.join(members.select(F.col("chosen").alias("id")).distinct(), "id", "left_semi").join(told, "id", "left")
    hashed = lambda values: F.transform(values, lambda x: F.xxhash64(x))
    prose = F.array_distinct(tokens(F.concat_ws(" ", "title", "summary", "evidence")))
    names = F.filter(F.array_distinct(F.concat(F.array(plain(F.col("subject"))), plain_set(F.col("products")), plain_set(F.col("organizations")))), lambda x: x != "")
    day = F.datediff("event_date", F.lit("1970-01-01").cast("date"))
    action = F.when(F.col("action").isNotNull(), F.xxhash64("action"))
    rows = chosen.select("id", day.alias("day"), plain(F.col("title")).alias("title"), hashed(prose).alias("words"), hashed(names).alias("names"), F.coalesce("told", F.array().cast("array<bigint>")).alias("told"), F.xxhash64(plain(F.col("subject"))).alias("subject"), action.alias("action"))
    pairs = tiling.met(written(rows, "stories"), "id", BLOCK_ROWS, _met, "a long, b long, by byte, verdict byte")
    named = lambda values, code: F.get(F.array(*[F.lit(v) for v in values]), F.col(code)).alias(code)
    return members, pairs.select("a", "b", named(BY, "by"), named(VERDICTS, "verdict"))
