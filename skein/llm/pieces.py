"""SentencePiece encoding and decoding over a trie of distinct words.

A text is normalised by the model's own rules and parted into marked words (the mark is the model's word-start sign).
The distinct words of a batch are sorted, which lays them out as a depth-first walk of their trie: each word keeps the
forward state of the prefix it shares with the word before and extends only the rest.

The forward state of a prefix is, for a unigram model, the best score and its last piece (Viterbi). A BPE model's pieces
are not the best-scoring ones but those that merging gives, so there the state is the last piece of the prefix's own
encoding: the one suffix piece whose neighbour, the last piece of the shorter prefix, would stay beside it when the two
are merged alone. That too depends on the prefix only, so it is shared in the same way, and equals the library's result.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import map_arrow, slices

MARK = "▁"
#: New words after which a task forgets those that it hasn't met since the last time (a limit of memory, not of results).
KEPT_WORDS = 150_000
KEPT_PAIRS = 400_000


@dataclass
class Vocabulary:
    """Pieces, scores and byte pieces of a model, and its normaliser."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int] | None
    unknown: int
    merging: bool
    processor: object

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores = {}, {}
        byte_ids: list[int | None] = [None] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece], scores[piece] = i, sp.get_score(i)
        # a model made by merging scores its pieces by rank: 0, -1, -2 and so on
        ranked = sorted((s for s in scores.values() if s > -1e8), reverse=True)
        merging = all(float(s).is_integer() for s in ranked)
        return Vocabulary(ids, scores, byte_ids if None not in byte_ids else None, sp.unk_id(), merging, sp)


def merged(word: str, scores: dict[str, float], down_to: int = 1) -> list[str]:
    """Byte-pair encoding of a word by definition: the best-scoring neighbouring pair (the leftmost of equals) is merged until none is a piece, or so few are left.

    Pairs wait in a heap and parts know their neighbours, so a run of n like characters takes n log n steps.
    """
    parts: list[str | None] = list(word)
    many, left, right = len(parts), list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(-s, k, parts[k] + parts[k + 1]) for k in range(many - 1) if (s := scores.get(parts[k] + parts[k + 1])) is not None]
    heapq.heapify(heap)
    remaining = many
    while heap and remaining > down_to:
        _, k, pair = heapq.heappop(heap)
        nxt = right[k]
        if parts[k] is None or nxt >= many or parts[k] + parts[nxt] != pair:
            continue  # one of the two has been merged since
        parts[k], parts[nxt] = pair, None
        remaining -= 1
        right[k] = right[nxt]
        if right[k] < many:
            left[right[k]] = k
        for a, b in ((left[k], k), (k, right[k])):
            if a >= 0 and b < many and (s := scores.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
    return [p for p in parts if p is not None]


class TrieEncoder:
    """Encodes sorted distinct words, keeping the forward states of the current path of their trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, scores = vocabulary, vocabulary.scores
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.lowest = min(scores.values(), default=0.0) - 10.0
        self.halves = {p: self._halved(p) for p in vocabulary.ids if len(p) > 1} if vocabulary.merging else {}
        #: Pieces that an encoding may have, as numbers.
        self.usable = {p: i for p, i in vocabulary.ids.items() if len(p) == 1 or not vocabulary.merging or self.halves[p]}
        self.by_id = {i: p for p, i in self.usable.items()}
        self.other = 1 + max(vocabulary.ids.values(), default=0)  # a character that is no piece
        #: Lengths of the pieces that end in the same three characters (or have no more than two), the longest first.
        self.sizes: dict[str, list[int]] = {}
        for ending, size in sorted({(p[-3:], len(p)) for p in self.usable if len(p) > 1}, key=lambda x: -x[1]):
            self.sizes.setdefault(ending, []).append(size)
        for ending in [x for x in self.sizes if len(x) == 3 and x[1:] in self.sizes]:
            self.sizes[ending] = self.sizes[ending] + [2]
        self.short = {x: [2] for x in self.sizes if len(x) == 2}
        self.word = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Marked words, parted further where no piece has the two neighbouring characters, so that nothing is merged across.

        Parted before ASCII signs and around line ends and tabs; characters that some piece has before a sign keep it.
        """
        pairs = {(x, y) for p in self.v.ids for x, y in zip(p, p[1:], strict=False)}
        lone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.v.ids)) if self.v.byte_ids else ""
        plain = lambda x: x.isascii() and x.isalnum()
        signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        signs -= {y for x, y in pairs if plain(x)}
        sticky = re.escape("".join(sorted({x for x, y in pairs if y in signs and x not in signs and x != MARK})))
        if not signs:
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        some, end = re.escape("".join(sorted(signs))), re.escape(lone)
        inner = f"(?:[^{MARK}{some}{end}{sticky}]+" + (f"|[{sticky}][{some}]*" if sticky else "") + ")"
        return f"{MARK}*(?:{inner}+|[{some}]+{inner}*)" + (f"|[{end}]+" if end else "") + f"|{MARK}+"

    def _halved(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives this one; None if merging its characters doesn't give it."""
        parts = merged(piece, self.v.scores, down_to=2)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _stays(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay two: no merge across their border comes before those that make them.

        Undoing the merges from the last one on, the pieces at the border are looked at as they were at each time.
        """
        scores, last, even = self.v.scores, -float("inf"), False
        x, y, got = self.by_id[left], self.by_id[right], True
        while True:
            across = scores.get(x + y)
            if across is not None and (across > last or even and across == last):
                got = False
                break
            a = scores[x] if len(x) > 1 else float("inf")
            b = scores[y] if len(y) > 1 else float("inf")
            if a < b:
                last, even, x = a, False, self.halves[x][1]
            elif b < float("inf"):
                last, even, y = b, True, self.halves[y][0]
            else:
                break
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = got
        return got

    def _merge_states(self, word: str, shared: int, path: list[int], sizes: list[int]) -> None:
        """Extends the states of word[:k] for k over shared: the number and length of the last piece of each prefix's encoding."""
        usable, pairs, other, endings, short = self.usable, self.pairs, self.other, self.sizes, self.short
        for end in range(shared + 1, len(word) + 1):
            found, length = usable.get(word[end - 1], other), 1
            if end > 1:
                for size in endings.get(word[end - 3 : end]) or short.get(word[end - 2 : end], ()) if end > 2 else short.get(word[:2], ()):
                    before = end - size
                    if before < 0:
                        continue
                    piece = usable.get(word[before:end])
                    if piece is None:
                        continue
                    if before:
                        left = path[before]
                        if left != other:
                            stays = pairs.get(left << 32 | piece)
                            if not (self._stays(left, piece) if stays is None else stays):
                                continue
                    found, length = piece, size
                    break
            path.append(found)
            sizes.append(length)

    def _score_states(self, word: str, shared: int, path: list[int], sizes: list[int], best: list[float]) -> None:
        """Extends the Viterbi states of word[:k] for k over shared."""
        scores, usable = self.v.scores, self.usable
        for end in range(shared + 1, len(word) + 1):
            one = word[end - 1]
            found, length, top = usable.get(one, self.other), 1, best[end - 1] + scores.get(one, self.lowest)
            for size in self.sizes.get(word[max(0, end - 3) : end]) or self.short.get(word[max(0, end - 2) : end], ()) if end > 1 else ():
                if size <= end and (piece := usable.get(word[end - size : end])) is not None:
                    score = best[end - size] + scores[word[end - size : end]]
                    if score > top:
                        found, length, top = piece, size, score
            path.append(found)
            sizes.append(length)
            best.append(top)

    def _plain(self, char: str) -> list[int]:
        """The numbers of a character that is no piece."""
        return [self.v.byte_ids[b] for b in char.encode()] if self.v.byte_ids else [self.v.unknown]

    def learn(self, words: set[str]) -> None:
        """Encodes the words not known yet, in sorted order."""
        path, sizes, best, last = [0], [0], [0.0], ""
        known, other, merging, pack = self.known, self.other, self.v.merging, struct.Struct
        packs = [pack(f"<{n}i").pack for n in range(64)]
        for word in sorted(words):
            if merging and word.startswith(MARK + MARK):
                # runs of marks have equal scores, for which the left one of two merges goes first
                ids = [i for p in merged(word, self.v.scores) for i in ([self.v.ids[p]] if p in self.v.ids else self._plain(p))]
                known[word] = struct.pack(f"<{len(ids)}i", *ids)
                continue
            most, shared = min(len(last), len(word)), 0
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], sizes[shared + 1 :]
            if merging:
                self._merge_states(word, shared, path, sizes)
            else:
                del best[shared + 1 :]
                self._score_states(word, shared, path, sizes, best)
            last, end, ids = word, len(word), []
            while end:
                if path[end] == other:
                    plain = self._plain(word[end - 1])
                    if self.v.byte_ids or not ids or ids[-1] != self.v.unknown:
                        ids += plain[::-1]
                else:
                    ids.append(path[end])
                end -= sizes[end]
            ids.reverse()
            known[word] = packs[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        find = self.word.findall
        parted = [find(x) for x in self.v.processor.normalize([t or "" for t in texts])]
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        missing: set[str] = set()
        for words in parted:
            missing.update(words)
        missing.difference_update(self.known)
        again = missing & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.learn(missing - again)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in parted]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        known = {i: p.replace(MARK, " ").encode() for p, i in vocabulary.ids.items()}
        known |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids or ())}
        known[vocabulary.unknown] = " ⁇ ".encode()
        self.pieces = [known.get(i, b"") for i in range(max(known) + 1)]

    def text(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", errors="replace")


_vocabularies: dict[str, Vocabulary] = {}
_encoders: dict[str, TrieEncoder] = {}
_decoders: dict[str, Decoder] = {}


def _vocabulary(path: str) -> Vocabulary:
    """The model at a path that every executor has (it comes with an installed package), loaded once a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary.load(path)
    return _vocabularies[path]


def _encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(_vocabulary(path))
    return _encoders[path]


def _decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(_vocabulary(path))
    return _decoders[path]


def encoded(text: Column, path: str) -> Column:
    """The piece ids of a text column, without begin or end signs; a null or empty text has none."""

    def run(texts: pa.Array) -> pa.Array:
        out, sizes = [], [np.zeros(1, np.int64)]
        encoder = _encoder(path)
        for part in slices(texts):
            ids = encoder.encode(part.to_pylist())
            out += ids
            sizes.append(np.array([len(x) for x in ids], np.int64))
        ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))

    return F.arrow_udf(run, "array<int>")(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of piece ids; null ids give an empty text. Exact for texts that the model's normaliser leaves as they are."""

    def run(lists: pa.Array) -> pa.Array:
        decoder = _decoder(path)
        values = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy()
        return pa.array([decoder.text(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return F.arrow_udf(run, "string")(F.coalesce(ids, F.array().cast("array<int>")))


def coded(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids`, the piece ids of `text`, and `decoded`, the text that these ids stand for.

    One worker encodes and decodes a megabyte of text at a time and hands it on, so a task never holds the ids of a whole
    Arrow batch. A null or empty text has no ids and an empty decoded text; columns of docs by these two names are
    replaced; repeated rows stay; an empty table gives an empty one.
    """
    rest = docs.drop("ids", "decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, decoder = _encoder(path), _decoder(path)
        ids = encoder.encode(batch.column("text").to_pylist())
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        texts = pa.array([decoder.text(x) for x in ids], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, lists, texts], names=schema.names)

    return map_arrow(rest, run, schema)
