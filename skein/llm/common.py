"""What the operators of this subpackage share: batches of text as one byte array, word hashes, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one numpy pass takes at a time (a longer text is one pass of its own).
CHUNK_BYTES = 1 << 20


# --- samples of labelled rows ----------------------------------------------------------------


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def hashed_share(rows: int, most: int, *columns: str) -> Column:
    """True for about `most` of so many rows, chosen by a hash of the columns; for all rows if there are no more than that."""
    if rows <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1_000_000)) < F.lit(int(1_000_000 * most / rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of labelled documents outside the held-out fold, with whole texts of any length.

    `most` bounds the label rows taken (a hash of the id chooses them), so the side that is broadcast is
    bounded whatever the input. Rows without an id, text or label are not learnt from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = known.where(hashed_share(known.count(), most, "doc_id"))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")


def within_bytes(sample: DataFrame, most: int) -> DataFrame:
    """The rows of a (persisted) sample, or, where their texts have over `most` bytes, a hashed share of them that has about so many.

    The share doesn't depend on a text's length, so short and long texts are learnt from alike.
    """
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sample.where(hashed_share(size, most, "doc_id", "y"))


# --- batches ---------------------------------------------------------------------------------


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch; it may return columns by name, or None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                out = function(piece)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, of one row at least."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    if at < 0:
        yield batch
        return
    _, offsets = byte_view(batch.column(at))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def slices(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """A string column in slices of about `most` bytes, of one row at least."""
    for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", most):
        yield part.column(0)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows in them; a null is as an empty text."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, places, data = texts.buffers()
    if places is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, count=n + 1, offset=texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


# --- words -----------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one running sum (wrapping arithmetic)."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of lower-cased texts, and the row of each.

    A word is a run of ASCII letters and digits and of non-ASCII characters other than
    Latin-1 punctuation (U+0080-00BF) and general punctuation (U+2000-203F); none crosses two rows.
    """
    inside = _WORD_BYTE[data]
    if len(data):
        low = np.flatnonzero(data == 0xC2)
        inside[low] = False
        inside[np.minimum(low + 1, len(data) - 1)] = False
        three = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80))
        for k in range(3):
            inside[np.minimum(three + k, len(data) - 1)] = False
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cuts = offsets[1:-1]
    at_cut = np.zeros(len(data) + 1, bool)
    at_cut[cuts] = True
    starts = np.flatnonzero(inside & (~before[:-1] | at_cut[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    ends = np.flatnonzero(before & (~after | at_cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
