"""Document fingerprints from Lempel-Ziv phrases.

A text's words are parsed into phrases: each phrase is the shortest run of words that is not a phrase yet. The set of
phrases is what the text's dictionary coder would have learned; its minimum-hash signature is the fingerprint, and the
share of equal places in two signatures estimates the shared part of two dictionaries, as compression together would.
Words are runs of other than white space, cut after every `PIECE` characters.

`neighbours` walks documents by descending doc_id. Ids are cut into ranges by their quantiles, as many as the size of
the input asks for; each range is ordered in a task, which walks it row by row, and each range's first row is also sent to the
range above it, whose last row it follows.

Defined results: a null text is empty; a text without words has the fingerprint of no phrases, which is like itself
(1) and unlike any other (0); equal texts have equal fingerprints; rows of equal doc_id follow each other by text, and
null doc_ids come last; a single row is its own next; an empty table gives an empty result. Long texts are parsed `CHUNK` characters at a
time; a task holds two rows and their phrases. Other columns are no input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read

SLOTS = 64
PIECE, CHUNK = 8, 1 << 18
#: Bytes of texts in a range, and ranges at most (their cuts are known to the driver and to every task).
RANGE_BYTES, RANGES = 8 << 20, 50_000
START, STEP, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
CACHED = 200_000
_PIECES = re.compile(rf"\S{{1,{PIECE}}}")
_ROLL = np.random.default_rng(20240601)
TIMES, PLUS = _ROLL.integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1), _ROLL.integers(0, 1 << 63, SLOTS, np.uint64)


class Hashes(dict):
    """Word -> 64-bit hash; of at most CACHED words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str) -> Iterator[list[str]]:
    """The words of text, cut, in lists; text begins where a word or white space does."""
    at = 0
    while at < len(text):
        chunk = text[at : at + CHUNK]
        if at + len(chunk) < len(text) and not chunk[-1].isspace():  # the last word goes on
            last = len(chunk.rsplit(None, 1)[-1])
            if last < len(chunk):
                chunk = chunk[:-last]
        yield _PIECES.findall(chunk)
        at += len(chunk)


def parse(hashes: list[int], seen: set[int], at: int = START) -> int:
    """Adds the phrases of words (by hash) to seen, going on from state `at`; gives the state then."""
    add = seen.add
    for h in hashes:
        at = (at ^ h) * STEP & MASK
        if at not in seen:
            add(at)
            at = START
    return at


def parsed(hashes: Hashes, text: str, seen: set[int], at: int = START) -> int:
    for words in words_of(text):
        at = parse([hashes[w] for w in words], seen, at)
    return at


def signature(phrases: set[int]) -> np.ndarray:
    if not phrases:
        return np.full(SLOTS, 0xFFFF, np.uint16)
    x = np.fromiter(phrases, np.uint64, len(phrases))
    x ^= x >> np.uint64(31)
    least = np.full(SLOTS, MASK, np.uint64)
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[k : k + 4096, None] * TIMES + PLUS).min(axis=0), out=least)
    return (least >> np.uint64(40)).astype(np.uint16)


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, none_a: bool, none_b: bool) -> float:
    return float(none_a == none_b) if none_a or none_b else float((a == b).mean())


def fingerprint(text: str | None) -> str:
    seen: set[int] = set()
    parsed(Hashes(), text or "", seen)
    return shown(signature(seen))


class Walk:
    """Rows in order: each is told the one that follows it."""

    def __init__(self):
        self.hashes = Hashes()
        self.last: tuple | None = None

    def prepared(self, key: object, text: str) -> tuple:
        """The row with its signature, and the parse of its first part, where the edited text goes on."""
        keep = len(text) - len(text) // 2
        first, tail = text[:keep], ""
        if keep < len(text) and first and not first[-1].isspace():  # the last word may go on
            tail = first.rsplit(None, 1)[-1]
            first = first[: keep - len(tail)]
        seen: set[int] = set()
        at = parsed(self.hashes, first, seen)
        half = set(seen)
        parsed(self.hashes, tail + text[keep:], seen, at)
        return key, text, signature(seen), not seen, keep, half, at, tail

    def closed(self, row: tuple, after: tuple) -> tuple:
        key, text, sig, none, keep, half, at, tail = row
        given = after[1][: len(text) // 2]
        parsed(self.hashes, tail + given, half, at)
        other = signature(half)
        edited = text[:keep] + given
        return key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), shown(sig), shown(other), likeness(sig, other, none, not half), likeness(sig, after[2], none, after[3])


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = ranges or min(RANGES, 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    # one number per range reaches the driver
    cuts = rows.agg(F.percentile_approx("_id", [k / ranges for k in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64)).astype(np.int32))

    tops = rows.select("_id", range_of("_id").alias("_r")).groupBy("_r").agg(F.max("_id").alias("top")).orderBy("_r").toPandas()
    firsts, numbers = tops["top"].to_numpy(np.int64), tops["_r"].to_numpy(np.int32)

    @F.pandas_udf("array<int>")
    def sent_to(ids: pd.Series) -> pd.Series:
        """The range of an id and, if the id comes first in it, the range above (behind the uppermost: the last)."""
        values = ids.to_numpy(np.int64)
        at = np.searchsorted(firsts, values)
        above = numbers[(at + 1) % len(numbers)]
        return pd.Series([[a, b] if first else [a] for a, b, first in zip(numbers[at].tolist(), above.tolist(), (firsts[at] == values).tolist(), strict=True)])

    sent = rows.select("_id", "doc_id", "text", F.posexplode(sent_to("_id")).alias("_extra", "_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk()
        last, place, ended = None, None, False  # the row that waits for its next; its range; whether that came
        for batch in batches:
            out = []
            for r, extra, key, text in zip(*(batch.column(c) for c in ("_r", "_extra", "doc_id", "text")), strict=True):
                r, extra = r.as_py(), extra.as_py()
                if r != place:
                    place, last, ended = r, None, False
                if ended:
                    continue
                row = walk.prepared(key.as_py(), text.as_py())
                if last is not None:
                    out.append(walk.closed(last, row))
                last, ended = row, extra
                if len(out) >= 2000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ordered = sent.repartitionByRange(max(1, len(tops)), "_r").sortWithinPartitions("_r", "_extra", F.col("_id").desc(), "text")
    return ordered.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"))
