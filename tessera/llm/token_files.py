"""Token ids in binary files: patched frame-of-reference blocks.

A file is a sequence of frames, each followed by one line feed, written in ascending doc_id order by Spark's own text
sink (so by its commit protocol, in any file system), and read back with Spark's binary source.

Frame, little-endian: b"TFR1"; u32 documents n; u64 ids m; u32 blocks b; u64 bytes of all blocks; then for each
document i64 doc_id, u8 null flag, u32 ids; then the block index, u32 place of each block's start; then the blocks.
A block holds BLOCK ids (the frame's last one fewer): u32 minimum; u8 width; u8 exceptions x (255 at most); the ids
less the minimum, each in width bits, low bits first; then x u8 places and x u32 values, less the minimum, of those that
need more. The width is the PERCENTILE-th of the widths that the block's ids need; more than 255 exceptions can't be.

Defined results: a null text is empty; every document ends in id `end`, so an empty one has one id; rows that repeat
are written each; a null doc_id comes first; an empty table has no frames and gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, scratch, until_the_end, written
from tessera.llm.words import parts, ragged, split

BLOCK = 256
PERCENTILE = 0.9
END = 1
#: Ids of a frame, about, and frames of a file at most.
FRAME_IDS = 300_000
FILE_FRAMES = 8
#: Pieces of words whose ids a worker keeps.
CACHED = 250_000
HEAD = struct.Struct("<4sIQIQ")


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits that each value below 2**32 needs."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(start of each block, blocks). ids: numbers below 2**32."""
    out, starts, at = [], [], 0
    n = len(ids)
    whole = n // BLOCK
    for rows in (ids[: whole * BLOCK].reshape(whole, BLOCK), ids[whole * BLOCK :].reshape(1, -1)):
        if not rows.size:
            continue
        size = rows.shape[1]
        low = rows.min(axis=1)
        rest = (rows - low[:, None]).astype(np.uint32)
        need = _bits(rest)
        width = np.sort(need, axis=1)[:, min(size - 1, int(np.ceil(PERCENTILE * size)) - 1)]
        more = need > width[:, None]
        packed: list[bytes] = [b""] * len(rows)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                bits = np.unpackbits(rest[own].view(np.uint8).reshape(len(own), size, 4), axis=2, bitorder="little")[:, :, :w]
                for k, line in zip(own.tolist(), np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little"), strict=True):
                    packed[k] = line.tobytes()
        row, place = np.nonzero(more)
        cut = np.searchsorted(row, np.arange(len(rows) + 1))
        values = rest[row, place].astype("<u4")
        place = place.astype(np.uint8)
        for k in range(len(rows)):
            a, b = cut[k], cut[k + 1]
            block = struct.pack("<IBB", int(low[k]), int(width[k]), int(b - a)) + packed[k] + place[a:b].tobytes() + values[a:b].tobytes()
            starts.append(at)
            at += len(block)
            out.append(block)
    return np.array(starts, "<u4"), b"".join(out)


def decode_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of blocks (bytes as uint8) that begin at starts."""
    out = np.zeros(len(starts) * BLOCK, np.uint32)
    if not len(starts):
        return out[:n]
    starts = starts.astype(np.int64)
    size = np.full(len(starts), BLOCK)
    size[-1] = n - BLOCK * (len(starts) - 1)
    low = data[starts[:, None] + np.arange(4)].astype(np.uint32) @ (np.uint32(1) << np.arange(0, 32, 8, dtype=np.uint32))
    width, extra = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    length = (size * width + 7) // 8
    for w, s in {(int(w), int(s)) for w, s in zip(width, size, strict=True)}:
        own = np.flatnonzero((width == w) & (size == s))
        if w:
            lines = data[(starts[own] + 6)[:, None] + np.arange((s * w + 7) // 8)]
            bits = np.unpackbits(lines, axis=1, bitorder="little")[:, : s * w].reshape(len(own), s, w)
            full = np.zeros((len(own), s, 32), np.uint8)
            full[:, :, :w] = bits
            values = np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
            out[own[:, None] * BLOCK + np.arange(s)] = values
    tail = starts + 6 + length
    block = np.repeat(np.arange(len(starts)), extra)
    place = data[ragged(tail, extra)].astype(np.int64)
    raw = data[ragged(tail + extra, 4 * extra)].reshape(-1, 4).astype(np.uint32)
    out[block * BLOCK + place] = raw @ (np.uint32(1) << np.arange(0, 32, 8, dtype=np.uint32))
    return (out + np.repeat(low, BLOCK))[:n]


def encode_frame(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("null", "u1"), ("n", "<u4")])
    docs["id"], docs["null"], docs["n"] = [x or 0 for x in doc_ids], [x is None for x in doc_ids], sizes
    return HEAD.pack(b"TFR1", len(doc_ids), len(ids), len(starts), len(blocks)) + docs.tobytes() + starts.tobytes() + blocks


def frames(data: memoryview, ids: bool = True) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
    """(documents: id, null, n; number of ids; ids unless not asked for) of each frame of a file."""
    at = 0
    while at < len(data):
        magic, n, m, b, size = HEAD.unpack_from(data, at)
        if magic != b"TFR1":
            raise ValueError(f"no frame at byte {at}")
        at += HEAD.size
        docs = np.frombuffer(data, [("id", "<i8"), ("null", "u1"), ("n", "<u4")], n, at)
        at += docs.nbytes
        starts = np.frombuffer(data, "<u4", b, at)
        at += starts.nbytes
        yield docs, m, decode_blocks(np.frombuffer(data, np.uint8, size, at), starts, m) if ids else None
        at += size + 1


class Encoder:
    """Ids of texts, from the ids of their distinct pieces, of which at most CACHED are kept.

    A text of white space and visible characters below U+0250 is lower-cased and cut by the vocabulary's own pattern in
    Arrow's string functions; each distinct piece goes to the library's model once. Any other text, or one that may
    hold a special token, goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        steps = [x["type"] for x in kind["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in kind["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("another kind of vocabulary")
        self.pattern = kind["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # U+0130 lower-cases to two characters
        self.other = "|".join(["[^\\x09-\\x0d -~\\x{a1}-\\x{12f}\\x{131}-\\x{24f}]", *{"".join(f"\\x{{{ord(c):x}}}" for c in x["content"][:2]) for x in kind["added_tokens"]}])
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # the byte-level alphabet: visible bytes stand for themselves, the others for characters from U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("I"), array("Q"), array("Q")

    def new(self, piece: str) -> int:
        k = self.known[piece] = len(self.starts)
        ids = [x.id for x in self.model.tokenize(piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode())))]
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        return k

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows, pieces, which = split(pc.replace_substring_regex(pc.utf8_lower(texts), self.pattern, r"\0 "))
        if len(self.known) + len(pieces) > CACHED:
            self.clear()
        get = self.known.get
        at = [k if (k := get(x)) is not None else self.new(x) for x in pieces.to_pylist()]
        which = np.array(at, np.int64)[which] if at else which
        starts, sizes = (np.array(x, np.int64)[which] for x in (self.starts, self.sizes))
        return np.bincount(rows, sizes, len(texts)).astype(np.int64), np.array(self.flat, np.uint32)[ragged(starts, sizes)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids end to end)."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.other))
        n, flat = self.plain(texts.filter(pa.array(~odd)))
        if not odd.any():
            return n, flat
        others = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        size, start = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        size[~odd], size[odd] = n, [len(x) for x in others]
        every = np.concatenate([flat, *others])
        place = np.cumsum(np.r_[0, n, size[odd]])
        start[~odd], start[odd] = place[: len(n)], place[len(n) : -1]
        return size, every[ragged(start, size)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Files of the ids of docs (doc_id, text), each document's followed by end, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def frame() -> pa.RecordBatch:
            made = encode_frame(names, np.concatenate(sizes), np.concatenate(ids))
            names.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["frame"])

        for batch in batches:
            for part in parts(batch, 1, 2_000_000):
                n, flat = encoder(part.column(1))
                out = np.full(len(flat) + len(n), end, np.uint32)
                out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                names.extend(part.column(0).to_pylist())
                sizes.append(n + 1)
                ids.append(out)
                if sum(map(len, ids)) >= FRAME_IDS:
                    yield frame()
        if names:
            yield frame()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(run, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_FRAMES).text(path)
    until_the_end(docs.sparkSession, path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at path."""
    name = F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", 1).cast("long"), F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", 2).cast("long")
    files = spark.read.format("binaryFile").load(path).select(name[0].alias("part"), name[1].alias("piece"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, content in zip(*batch.columns, strict=True):
                at = 0
                for docs, m, ids in frames(memoryview(content.as_buffer())):
                    ends = np.cumsum(docs["n"].astype(np.int64))
                    begin = ends - docs["n"]
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(docs), part.as_py())), pa.array(np.full(len(docs), piece.as_py())), pa.array(docs["id"], mask=docs["null"].astype(bool)), pa.array(begin + at), pa.array(docs["n"].astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["part", "piece", "doc_id", "_at", "n_tokens", "ids_crc32"])
                    at += m

    # each file is read once; its documents, without their ids, are kept
    found = written(files.mapInArrow(rows, "part long, piece long, doc_id long, _at long, n_tokens long, ids_crc32 long"), "token-rows")
    sums = found.groupBy(F.col("part").alias("_part"), F.col("piece").alias("_piece")).agg(F.sum("n_tokens").alias("_n"))
    # one row per file
    sums = sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part", "_piece")) - F.col("_n"))
    met = found.join(sums, (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece")))
    return met.select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_back(spark, path)
