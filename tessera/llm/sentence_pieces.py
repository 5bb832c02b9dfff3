"""SentencePiece encoding and decoding of BPE vocabularies, by suffix-array matching.

The distinct segments of a batch (words with the spaces before them) are laid end to end and their suffixes sorted.
Every piece is looked up by binary search; its range of suffixes lists all its occurrences. These are the edges of a
lattice over byte positions. Sorted by position they are relaxed: an edge from a place reaches its end only if the
piece may follow the last piece of the encoding up to there. Merges never leave two neighbours that merging their
concatenation would have joined otherwise, so at each place just one piece can come last, and the last pieces, read
backwards from a segment's end, are the library's encoding. Characters that no piece holds become byte tokens.

Whether two pieces may be neighbours is decided by undoing merges from the latest, piece by piece, for as long as no
pair across their border would have merged earlier. Pieces of several spaces all have one score in such files and merge
last, from the left; a run of spaces that is left over is merged so, once for each length.

Defined results: a null or empty text has no ids and decodes to an empty text; decoding gives the text back, but for
the mark U+2581, which comes back as a space; repeated rows are encoded alike; other columns are no input. A segment
longer than `LONG` characters is indexed `INDEXED` bytes at a time and relaxed place by place instead of beside others,
with the same ids in time and memory that grow with its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from tessera.llm.common import read
from tessera.llm.pieces import segments, vocabulary
from tessera.llm.suffixes import compare, eights, padded, suffix_array
from tessera.llm.words import lean, parts, ragged

#: Distinct segments whose ids a task keeps, and bytes of new ones that are indexed at once.
CACHED = 200_000
INDEXED = 400_000
#: Characters beyond which a segment is relaxed by itself.
LONG = 4000
NEVER = np.int64(1) << 40
#: Bits of the table of pairs.
TABLE = 20


class Merges:
    """The pieces of a vocabulary that merging can make, in order of their merge, and which of them may be neighbours.

    Tokens are numbered by rank here: single characters first, which nothing makes, then pieces by falling score.
    """

    def __init__(self, path: str):
        words = vocabulary(path)
        self.byte = np.array([words.byte[b] for b in range(256)], np.int64)
        self.runs = {len(p): i for p, i in words.pieces.items() if not p.strip(" ")}
        text = [p for p in words.pieces if len(p) == 1 or p.strip(" ")]
        if len({words.score[words.pieces[p]] for p in text if len(p) > 1}) < sum(len(p) > 1 for p in text):
            raise ValueError("pieces of equal score")
        text.sort(key=lambda p: (len(p) > 1, -words.score[words.pieces[p]], p))
        made: dict[str, tuple[str, str]] = {}
        rank = {p: k for k, p in enumerate(text)}
        for p in text:
            if len(p) > 1 and (last := self._last_merge(p, rank)):
                made[p] = last
        # a piece that merging its own characters doesn't give is never in an encoding
        text = [p for p in text if len(p) == 1 or p in made]
        self.rank = {p: k for k, p in enumerate(text)}
        self.ids = np.array([words.pieces[p] for p in text], np.int64)
        n = len(text)
        self.singles = sum(len(p) == 1 for p in text)
        self.single = {p for p in text if len(p) == 1}
        self.left, self.right = (np.array([self.rank[made[p][k]] if p in made else -1 for p in text], np.int64) for k in (0, 1))
        pairs = {}
        for p in text:
            for k in range(1, len(p)):
                a, b = self.rank.get(p[:k]), self.rank.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[p]
        self.pairs = pairs
        # a table of keys by hash; what doesn't fit its place goes to the next free one
        self.table, self.joined, self.probes = np.full((1 << TABLE) + 64, -1, np.int64), np.full((1 << TABLE) + 64, NEVER, np.int64), 1
        keys = np.array(list(pairs), np.int64)
        for at, key in zip(self._place(keys).tolist(), keys.tolist(), strict=True):
            k = 0
            while self.table[at + k] >= 0:
                k += 1
            self.table[at + k], self.joined[at + k], self.probes = key, pairs[key], max(self.probes, k + 1)
        raw = [p.encode() for p in text]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = eights(padded(b"".join(raw)))

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
        """The two pieces whose merge ends the merging of piece's characters, if that ends in piece."""
        parts_ = list(piece)
        while len(parts_) > 1:
            found = [(rank[x], k) for k in range(len(parts_) - 1) if (x := parts_[k] + parts_[k + 1]) in rank]
            if not found:
                return None
            _, k = min(found)
            last = parts_[k], parts_[k + 1]
            parts_[k : k + 2] = ["".join(last)]
        return last

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b merge into, NEVER if none."""
        key = a * len(self.ids) + b
        at = self._place(key)
        found = self.table[at]
        out = np.where(found == key, self.joined[at], NEVER)
        left = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] += 1
            found = self.table[at[left]]
            out[left] = np.where(found == key[left], self.joined[at[left]], NEVER)
            left = left[(found != key[left]) & (found >= 0)]
        return out

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).astype(np.int64)

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that nothing else merged with: the leftmost pair that is a piece merges, again and again."""
        done: list[int] = []  # lengths from the left, of which no two neighbours merge
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return [self.runs[k] for k in done]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may come right after a in an encoding; -1 is a character that no piece holds."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b, limit = a[live], b[live], np.full(len(live), NEVER)
        while len(live):
            wrong = self.pair(a, b) < limit
            out[live[wrong]] = False
            # of the two, undo the later merge; of equal ones the right, as merging goes from the left
            undo_a = (a > b) & (a >= self.singles)
            undo_b = ~undo_a & (b >= self.singles)
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            stay = ~wrong & (undo_a | undo_b)
            live, a, b, limit = live[stay], a[stay], b[stay], limit[stay]
        return out

    def one_may_follow(self, a: int, b: int) -> bool:
        """may_follow for one pair."""
        n, limit, joined, singles = len(self.ids), int(NEVER), self.pairs.get, self.singles
        left, right = self.halves
        while a >= 0 and b >= 0:
            if joined(a * n + b, limit) < limit:
                return False
            if a > b and a >= singles:
                limit, a = a, right[a]
            elif b >= singles:
                limit, b = b + 1, left[b]
            else:
                return True
        return True

    @cached_property
    def halves(self) -> tuple[list[int], list[int]]:
        return self.left.tolist(), self.right.tolist()

    def edges(self, words: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of every occurrence of every piece in a text whose suffixes are in order."""
        n = len(self.ids)
        low, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            for out, above in ((low, 1), (top, 0)):
                a, b = np.zeros(len(own), np.int64), np.full(len(own), len(order), np.int64)
                while (a < b).any():
                    mid = (a + b) >> 1
                    live = a < b
                    more = np.zeros(len(own), bool)
                    more[live] = compare(self.words, self.starts[own[live]], words, order[mid[live]], int(size)) >= above
                    a, b = np.where(live & more, mid + 1, a), np.where(live & ~more, mid, b)
                out[own] = a
        many = top - low
        return order[ragged(low, many)], np.repeat(np.arange(n), many)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def encode_segments(by: Merges, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each distinct segment, ids end to end)."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = padded(b"\xff".join(raw) + b"\xff")
    words = eights(text)
    order, _ = suffix_array(words)
    place, piece = by.edges(words, order)
    n = len(words)
    # characters that are no piece
    body = text[:n]
    begins = (body & 0xC0) != 0x80
    begins[starts + sizes] = False
    known = np.zeros(n, bool)
    known[place[piece < by.singles]] = True
    odd = np.flatnonzero(begins & ~known)
    width = np.where(body[odd] < 0x80, 1, np.where(body[odd] < 0xE0, 2, np.where(body[odd] < 0xF0, 3, 4))).astype(np.int64)
    place = np.concatenate([place, odd])
    size = np.concatenate([by.sizes[piece], width])
    piece = np.concatenate([piece, np.full(len(odd), -1)])
    # by place within their segment: all edges that end before a step's places are relaxed before it
    base = np.repeat(starts, sizes + 1)
    step = place - base[place]
    by_step = np.argsort(step, kind="stable")
    place, size, piece, step = place[by_step], size[by_step], piece[by_step], step[by_step]
    last, before = np.full(n + 1, -2, np.int64), np.zeros(n + 1, np.int64)
    cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at, to, p = place[a:b], place[a:b] + size[a:b], piece[a:b]
        good = np.ones(b - a, bool) if step[a] == 0 else by.may_follow(last[at], p)
        last[to[good]], before[to[good]] = p[good], size[a:b][good]
    # from each segment's end back to its start
    live, at = np.flatnonzero(sizes > 0), (starts + sizes)[sizes > 0]
    found = []
    while len(live):
        if (before[at] == 0).any():
            raise AssertionError("a place without a last piece")
        found.append((live, last[at], at - before[at]))
        at = at - before[at]
        more = at > starts[live]
        live, at = live[more], at[more]
    if not found:
        return np.zeros(len(texts), np.int64), np.empty(0, np.int64)
    which, token, at = (np.concatenate([f[k] for f in found[::-1]]) for k in range(3))
    in_order = np.argsort(at, kind="stable")
    which, token, at = which[in_order], token[in_order], at[in_order]
    # a character that is no piece gives one id for each of its bytes
    wide = np.where(body[at] < 0x80, 1, np.where(body[at] < 0xE0, 2, np.where(body[at] < 0xF0, 3, 4))).astype(np.int64)
    many = np.where(token < 0, wide, 1)
    ids = np.where(np.repeat(token, many) < 0, by.byte[body[ragged(at, many)]], by.ids[np.repeat(token, many)])
    return np.bincount(which, many, len(texts)).astype(np.int64), ids


def encode_long(by: Merges, text: str) -> np.ndarray:
    """Ids of one long segment: the same edges and the same relaxation, for a stretch of the text after the other."""
    raw, longest, sizes = text.encode(), int(by.sizes.max()), by.sizes.tolist()
    n = len(raw)
    last, before, known = array("i", [-2]) * (n + 1), array("H", [0]) * (n + 1), {}
    for base in range(0, n, INDEXED):
        stretch = padded(raw[base : base + INDEXED + longest])
        words = eights(stretch)
        place, piece = by.edges(words, suffix_array(words)[0])
        by_place = np.argsort(place, kind="stable")
        place, piece = place[by_place], piece[by_place]
        cuts = np.searchsorted(place, np.arange(min(INDEXED, n - base) + 1)).tolist()
        piece = piece.tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = base + k
            if raw[at] & 0xC0 == 0x80:
                continue
            own, single = last[at], False
            for p in piece[a:b]:
                single |= p < by.singles
                size = sizes[p]
                if at + size <= n:
                    good = known.get((own, p)) if at else True
                    if good is None:
                        if len(known) > CACHED:
                            known.clear()
                        good = known[own, p] = by.one_may_follow(own, p)
                    if good:
                        last[at + size], before[at + size] = p, size
            if not single:  # a character that no piece holds
                size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                last[at + size], before[at + size] = -1, size
    out, at = array("I"), n
    while at:
        size, p = before[at], last[at]
        if not size:
            raise AssertionError("a place without a last piece")
        out.extend([int(by.ids[p])] if p >= 0 else by.byte[list(raw[at - size : at][::-1])].tolist())
        at -= size
    return np.array(out, np.int64)[::-1]


class Encoder:
    def __init__(self, path: str):
        self.by, self.words = merges(path), vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("I"), array("Q"), array("Q")

    def learn(self, tokens: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        ends = np.cumsum(n) + len(self.flat)
        self.known.update(zip(tokens, range(len(self.starts), len(self.starts) + len(tokens)), strict=True))
        self.starts.extend((ends - n).tolist())
        self.sizes.extend(n.tolist())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids end to end)."""
        rows, distinct, which = segments(texts)
        if len(self.known) + len(distinct) > CACHED:
            self.clear()
        tokens = distinct.to_pylist()
        # of several spaces before a word, only the last can merge with it
        new = [t for t in tokens if t not in self.known]
        wide = {t: len(t) - len(t.lstrip(" ")) for t in new if t[:2] == "  "}
        if wide:
            new = [t for t in dict.fromkeys(t[wide[t] - 1 :] if t in wide else t for t in new) if t not in self.known]
        for t in [t for t in new if len(t) > LONG]:
            ids = encode_long(self.by, t)
            self.learn([t], np.array([len(ids)]), ids)
        new = [t for t in new if len(t) <= LONG]
        for cut in np.split(np.arange(len(new)), np.flatnonzero(np.diff(np.cumsum([len(t) for t in new]) // INDEXED)) + 1) if new else []:
            some = [new[k] for k in cut.tolist()]
            self.learn(some, *encode_segments(self.by, some))
        lone = self.by.ids[self.by.rank[" "]]
        for t, n in wide.items():
            k = self.known[t[n - 1 :]]
            ids = self.flat[self.starts[k] : self.starts[k] + self.sizes[k]].tolist()
            ids = self.by.spaces(n) + ids[1:] if ids[0] == lone else self.by.spaces(n - 1) + ids
            self.learn([t], np.array([len(ids)]), np.array(ids))
        at = np.array([self.known[t] for t in tokens], np.int64)
        at = at[which] if len(at) else at
        starts, sizes = (np.array(x, np.int64)[at] for x in (self.starts, self.sizes))
        return np.bincount(rows, sizes, len(texts)).astype(np.int64), np.array(self.flat, np.uint32)[ragged(starts, sizes)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.words.text.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, model: str, *keep: str) -> DataFrame:
    """keep..., n_tokens, ids, ids_crc32 (as little-endian unsigned 32-bit numbers), round_trip (decoding gives the text) for every row of docs."""
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("ids_crc32", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for part in parts(batch, len(keep)):
                texts = part.column(len(keep))
                n, flat = encoder.encode(texts)
                ends = np.cumsum(n)
                raw = memoryview(flat.astype("<u4").tobytes())
                crc, same = [], []
                for a, b, text in zip((ends - n).tolist(), ends.tolist(), texts.to_pylist(), strict=True):
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    same.append(encoder.decode(flat[a:b].tolist()) == (text or "").replace("▁", " "))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n), lists, pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(lean(run), schema)


def decoded(tokens: DataFrame, model: str, *keep: str) -> DataFrame:
    """keep..., text for every row of tokens (ids: array<int>)."""
    schema = tokens.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=schema.names)

    return tokens.select(*keep, "ids").mapInArrow(run, schema)


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id")
